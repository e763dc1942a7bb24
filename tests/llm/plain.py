"""Plain Python that the tests hold results against."""

from test_simhash import brute, plain_fingerprint


def smallest_ids(texts):
    """The smallest id of every near-duplicate component."""
    ids = sorted(texts)
    return {ids[k] for k in set(brute([plain_fingerprint(texts[i]) for i in ids]))}
