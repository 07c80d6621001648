"""The archive query and its SQL: written, read back."""

from ..plans.registry import query
from ..session import scratch_path
from . import warc as W

_B32 = """array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
          lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || h[i * 5 + 1:i * 5 + 5])::BIGINT // k) % 32 + 1]), '')), '')"""


@query("op9_warc_archive", f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
    SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM g""")
def op9_warc_archive(t):
    folder = scratch_path(t.spark, "warc")
    W.write_archives(t.pages, folder).count()
    return W.read_archives(t.spark, folder, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
