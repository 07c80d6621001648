"""The whitening query.  SQL has no eigenvectors; the tests compare it with one dense computation."""

from ..plans.registry import query
from . import whitening as W


@query("op11_embedding_whitening")
def op11_embedding_whitening(t):
    return W.whiten(t.embeddings)
