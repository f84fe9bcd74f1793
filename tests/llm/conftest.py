import pytest


@pytest.fixture(params=["/root/testdata/sf0.001"])
def sf(request):
    import os

    if not os.path.isdir(request.param):
        pytest.skip("given tables are absent")
    return request.param
