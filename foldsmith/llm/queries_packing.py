"""The packing query.  SQL has no tokenizer, so the tests check it against a plain one and by unpacking."""

import public_tokenizers

from ..plans.registry import query
from . import packing as P

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1_best_fit_packing(t):
    return P.pack(t.documents, TOKENIZER)
