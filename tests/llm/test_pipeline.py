"""The pipeline against its stages done by brute force, and its contract."""

import os

import pytest

import corpus_pipeline as P
from tests.llm.test_line_dedup import brute as brute_lines, norm
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="testdata not present")
def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from claimspark.llm import quality_rules
    good = {r.doc_id for r in quality_rules.report(docs).filter("kept").collect()}
    held = {}
    for name, stage in P.STAGES[:4]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = P.stored(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held[name] = (before, after)
    before, after = held["quality_rules"]
    assert set(after) == good and all(before[i] == after[i] for i in after)
    before, after = held["line_dedup"]
    rows = [(i, r.text) for i, r in before.items()]
    import hashlib
    want = {i: sha for i, _, _, sha in brute_lines(rows, 5, 40)}
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
    before, after = held["simhash_near_dedup"]
    groups = brute_groups({i: r.text for i, r in before.items()}, 4, 4)
    assert set(after) == {c for _, c in groups.values()}
    before, after = held["mixing"]
    assert before == after
    pieces = P.STAGES[4][1](spark, docs, SF).collect()
    check([(i, r.text) for i, r in after.items()], pieces)


@pytest.mark.skipif(not os.path.exists(SF), reason="testdata not present")
def test_run_is_registered_and_gives_the_pieces(spark):
    import __spark_entry__ as E
    out = E.queries()["pipeline"](spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 50


def test_empty_documents_pass_every_stage(spark, docs):
    df = docs([])
    for name, stage in P.STAGES:
        df = P.stored(stage(spark, df, ""), f"empty-{name}")
        assert df.count() == 0


def test_defined_cases_through_every_stage(spark):
    import random
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))

    copy, long = prose(120), prose(60_000)
    rows = [(1, None), (2, ""), (3, "short"), (None, prose(90)), (None, prose(90)), (4, copy), (5, copy), (5, copy), (6, long),
            (7, "\n".join([prose(30), prose(60)])), (-8, prose(70)), (9, prose(80) + "\n\n" + prose(40))]
    names = ("doc_id bigint, text string, lang string, source string, n_chars bigint, root bigint, __llm_x int, fp string, "
             "slot bigint, bucket int, k1 string")
    df = spark.createDataFrame([(i, t, None if j % 3 else "en", None if j % 2 else "s", None, 7, 8, "f", 9, 1, "k")
                                for j, (i, t) in enumerate(rows)], names).repartition(3)
    columns, seen = df.columns, []
    for name, stage in P.STAGES[:4]:
        df = P.stored(stage(spark, df, ""), f"odd-{name}")
        assert df.columns == columns, name
        seen.append(sorted(((r.doc_id, r.text) for r in df.collect()), key=str))
        assert all((r.root, r.fp, r.slot, r.k1) == (7, "f", 9, "k") for r in df.collect())
    kept = [i for i, _ in seen[0]]
    assert not {1, 2, 3} & set(kept) and kept.count(5) == 2 and kept.count(None) == 2 and 6 in kept
    assert [i for i, _ in seen[1]].count(5) == 2 and dict(seen[1])[6] == long
    assert {i for i, _ in seen[2]} == {None, 4, 6, 7, -8, 9} and len(seen[2]) == 7  # the copies of 4 go, rows without an id stay
    assert seen[3] == seen[2]
    pieces = P.STAGES[4][1](spark, df, "").collect()
    assert sum(r.start == 0 for r in pieces) == 7 and sum(r.length for r in pieces if r.doc_id == 6) == next(r.doc_tokens for r in pieces if r.doc_id == 6)
