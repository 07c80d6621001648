"""The conversation query.  SQL cannot express the decoder; the tests compare it with all edit sequences."""

from ..plans.registry import query
from . import turn_repair as R


@query("op12_turn_repair")
def op12_turn_repair(t):
    return R.summarize(R.damage(t.conversations), gone_col="gone")
