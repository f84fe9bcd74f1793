"""Rule tagger: lexicon sets first, then suffixes, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

# The tag classes the templates look for.
ADJECTIVE_TAGS = ("J", "JJR", "JJS")
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
ADVERB_TAGS = ("RB", "RBR", "RBS")
VERB_TAGS = ("VB", "VBD")

UNKNOWN_TAG = "X"
NOUN_SUFFIXES = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ship", "hood", "ware")
MAX_LEXICON = 50_000


def default_lexicon() -> dict[str, str]:
    words = {w: "NN" for w in (*W.AGENT_NOUNS, *W.PRODUCT_NOUNS)}
    words.update({w: UNKNOWN_TAG for w in W.PLAIN_WORDS})
    words.update({w: "JJR" for w in W.COMPARATIVES})
    words.update({w: "JJS" for w in W.SUPERLATIVES})
    return words


@dataclass(frozen=True)
class RuleTagger:
    """``lexicon`` maps words to tags and wins over the suffix rules.

    It travels as literal hash sets inside the plan, so its size is checked.
    """

    lexicon: dict[str, str] = field(default_factory=default_lexicon)
    noun_suffixes: tuple[str, ...] = NOUN_SUFFIXES

    def __post_init__(self) -> None:
        if len(self.lexicon) > MAX_LEXICON:
            raise ValueError(f"lexicon has more than {MAX_LEXICON} entries")

    def words_by_tag(self) -> dict[str, list[str]]:
        grouped: dict[str, list[str]] = {}
        for word, tag in self.lexicon.items():
            grouped.setdefault(tag, []).append(word)
        return {tag: sorted(words) for tag, words in sorted(grouped.items())}

    def suffix_rules(self) -> list[tuple[str, str]]:
        """(suffix, tag) in order of precedence."""
        rules = [("est", "JJS"), ("er", "JJR")]
        rules += [(s, "NN") for s in self.noun_suffixes]
        return rules + [(plural(s), "NNS") for s in self.noun_suffixes]

    def column(self, word: Column) -> Column:
        """Tag of one word; works on columns and on lambda variables.

        Two hash-set guards let the common unknown word skip the rule list.
        """
        grouped = self.words_by_tag()
        rules = self.suffix_rules()
        endings = sorted({suffix[-2:] for suffix, _ in rules})
        singular = F.substring(word, F.lit(1), F.length(word) - 1)
        by_lexicon = _first([(word.isin(words), tag) for tag, words in grouped.items()])
        by_suffix = _first([(word.endswith(suffix), tag) for suffix, tag in rules])
        tag = F.when(word.isin(sorted(self.lexicon)), by_lexicon)
        if grouped.get("NN"):
            is_plural = word.endswith("s") & singular.isin(grouped["NN"])
            tag = tag.when(is_plural, F.lit("NNS"))
        tag = tag.when(F.substring(word, -2, 2).isin(endings), by_suffix)
        return tag.otherwise(F.lit(UNKNOWN_TAG))


def plural(noun: str) -> str:
    if noun.endswith("ity"):
        return noun[:-1] + "ies"
    return noun + ("es" if noun.endswith("ss") else "s")


def _first(rules: list[tuple[Column, str]]) -> Column:
    """Tag of the first rule that holds."""
    branches = F
    for condition, tag in rules:
        branches = branches.when(condition, F.lit(tag))
    return branches.otherwise(F.lit(UNKNOWN_TAG)) if rules else F.lit(UNKNOWN_TAG)


DEFAULT_TAGGER = RuleTagger()
