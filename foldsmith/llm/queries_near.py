"""Near-duplicate queries.  Components of links are beyond plain SQL; the tests compare with all pairs."""

from ..plans.registry import query
from . import ngram_join as N
from . import nn_descent as D


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(t):
    return N.jaccard_components(t.documents)


@query("op8_nn_descent")
def op8_nn_descent(t):
    return D.near_components(t.embeddings)
