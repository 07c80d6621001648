"""The extraction query.  SQL has no HTML parser; the tests check it on pages whose article is known."""

from ..plans.registry import query
from . import site_tree as S


@query("op5_site_style_tree")
def op5_site_style_tree(t):
    return S.extract(t.pages).select("page_id", "url", "text", "n_chars")
