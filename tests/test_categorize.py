from foldsmith.operators import categorize as G

LOOKUP = "target string, effect string, assay string, std_type string, action string, assay_id string"


def setup(spark):
    rows = spark.createDataFrame([
        (1, "t", "Ki", "a1", "displacement of [3H]"), (2, "t", "Ki", "a2", "unclear"), (3, "t", "Ki", "a3", "affinity, agonist"),
        (4, "t", "EC50", "a4", "GTP gammaS binding"), (5, "t", "IC50", "a5", "GTP affinity"), (6, "t", "Ki", "a6", None),
        (7, "t", "Ki", "a7", "affinity")], "id long, target string, std_type string, assay_id string, text string")
    lookup = spark.createDataFrame([
        ("t", "bind", "RBA", "Ki", "plus", "a2"), ("t", "bind", "RBA", "Ki", "plus", "a1"), ("t", "bind", "RBA", "Ki", "plus", "a6"),
        ("t", "bind", "RBA", "Ki", "exclude", "a7")], LOOKUP)
    return rows, lookup


def hits(spark):
    rows, lookup = setup(spark)
    found = G.match_rules(rows, G.RULES, "text", "std_type")
    return G.apply_lookup(found, lookup, "target", "std_type", "assay_id", "id")


def test_a_row_may_meet_several_rules(spark):
    found = {(r["id"], r["effect"], r["assay"]): r["matched"] for r in hits(spark).collect()}
    assert found[5, "antag", "G-GTP"] and not found[5, "bind", "RBA"]
    assert found[4, "agon", "G-GTP"] and (4, "bind", "RBA") not in found
    assert found[1, "bind", "RBA"] and not found[3, "bind", "RBA"] and not found[6, "bind", "RBA"]


def test_lists_add_and_exclude(spark):
    chosen = [r["id"] for r in G.selected(hits(spark)).filter("effect = 'bind'").collect()]
    assert sorted(chosen) == [1, 2, 6]
    twice = [r["id"] for r in G.selected(hits(spark), dedupe=False).filter("effect = 'bind'").collect()]
    assert sorted(twice) == [1, 1, 2, 6]


def test_levels(spark):
    rows, lookup = setup(spark)
    out = G.categorize(rows, G.RULES, lookup, "id", "target", "std_type", "assay_id", "text", low=1, high=1).collect()
    by = {}
    for r in out:
        by.setdefault(r["level"], set()).add((r["row_id"], r["effect"], r["assay_id"]))
    assert by["hhd"] == {(i, None, None) for i in range(1, 8)}
    assert {i for i, e, _ in by["mhd"] if e == "bind"} == {1, 2, 6}
    assert by["lhd"] == {(i, e, f"a{i}") for i, e, _ in by["mhd"]}
    assert by["mhd-effect"] == by["mhd"]
    assert "lhd" not in {r["level"] for r in G.categorize(rows, G.RULES, lookup, "id", "target", "std_type", "assay_id", "text").collect()}
