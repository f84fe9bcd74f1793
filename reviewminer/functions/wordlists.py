"""Word lists used by the tokeniser and the rule tagger."""

from __future__ import annotations

import re

# The English stop-word list, in its natural order. The two
# punctuation marks at the end belong to it.
STOPWORDS_TEXT = """
a about above after again against all am an and any are aren't as at be because
been before being below between both but by can't cannot could couldn't did
didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd she'll
she's should shouldn't so some such than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've
were weren't what what's when when's where where's which while who who's whom
why why's with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves . ,
"""


def split_stopwords(text: str) -> tuple[str, ...]:
    """Tokenise a stop-word list the way reviews are tokenised.

    ``can't`` must contribute ``ca`` and ``n't``, because that is what the
    tokeniser leaves of it in a review.
    """
    text = re.sub(r"\bcannot\b", "can not", text.lower().replace("n't", " n't"))
    found = re.findall(r"n't|'(?:s|m|d|re|ve|ll)|[^\W_]+|\S", text)
    return tuple(dict.fromkeys(found))


STOPWORDS = split_stopwords(STOPWORDS_TEXT)

# The tagger's own small lexicon: words that the suffix rules would tag wrongly.
# Irregular and short comparatives / superlatives.
COMPARATIVES = (
    "better worse less lesser further farther larger smaller bigger louder "
    "cheaper nicer easier faster slower"
).split()
SUPERLATIVES = "best worst least furthest farthest".split()
# Words in -er / -est that are not comparatives.
AGENT_NOUNS = (
    "player printer computer paper power water number letter order customer "
    "speaker charger adapter adaptor monitor filter cover corner counter center "
    "layer leather lighter cleaner container computer controller receiver "
    "recorder scanner router server user owner buyer seller reader reviewer "
    "manufacturer designer starter holder hanger timer trailer trigger tuner "
    "amplifier folder finger shoulder weather winter summer dinner mother father "
    "brother sister daughter test request guest forest chest interest contest"
).split()
# Everyday product nouns without a telling suffix.
PRODUCT_NOUNS = (
    "sound screen display battery price quality camera color size weight case "
    "cable keyboard mouse money value fun time product item thing design style "
    "picture video photo phone laptop tablet book music guitar bass string toy "
    "game light lamp fluid life fit look feel idea deal choice option version "
    "model brand part piece job work"
).split()
# Neither comparatives nor nouns although they end in -er / -est.
PLAIN_WORDS = "never ever however rather either neither together another later honest modest".split()
