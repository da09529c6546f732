"""Plain versions of the operators, for small inputs."""

from test_decontaminate import brute as _decontaminate
from test_jaccard import brute as _jaccard
from test_lines import brute as _lines


def kept_lines(texts):
    return [(kept, removed) for kept, _, removed in _lines(texts)]


def similar(texts):
    return {i: root for i, (_, root) in _jaccard(texts).items()}


def contaminated(text, items):
    return _decontaminate(text, items)[-1]
