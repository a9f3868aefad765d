"""Language identification: features by hand, machines, held-out accuracy, defined cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import language_id as li, queries
from claimspark.llm.common import buffers

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string"
WORDS = {"en": "the house and water of morning with nothing there", "de": "das haus und wasser der morgen mit nichts dort",
         "fr": "la maison et eau du matin avec rien ici", "es": "casa y agua de mañana con nada aquí el"}


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    names = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[names[i % 4]].split(), int(rng.integers(4, 12)))), names[i % 4]) for i in range(n)]


def by_hand(text):
    """{cell: value} of a text, sequence by sequence."""
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
    counts = Counter()
    for order in range(1, li.ORDERS + 1):
        for i in range(len(data) - order + 1):
            gram = data[i:i + order]
            if gram == b" " or b"  " in gram:
                continue
            mixed = ((int.from_bytes(gram, "little") ^ (order * 0x01000193 & 0xFFFFFFFF)) * 2654435761) & 0xFFFFFFFF
            counts[mixed >> (32 - li.BITS)] += 1
    norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in counts.values()))
    return {c: (1 + math.log(n)) / norm for c, n in counts.items()}


def vectors(texts):
    data = pa.array([f" {t.lower()} ".encode() for t in texts], pa.binary())
    row, cell, value = li.features(*buffers(data))
    return [dict(zip(cell[row == i].tolist(), value[row == i].tolist())) for i in range(len(texts))]


def test_features_are_those_counted_by_hand():
    texts = ["The house, the HOUSE  and 42 houses.", "x", "", "1234", "été ÇA déjà", "a b c", "日本語 テキスト"]
    for got, text in zip(vectors(texts), texts):
        want = by_hand(text)
        assert got.keys() == want.keys()
        assert all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_a_very_long_text_is_counted_piece_by_piece(monkeypatch):
    text = " ".join(f"word{i} é{'x' * (i % 7)}" for i in range(3000))
    whole = vectors([text])[0]
    monkeypatch.setattr(li, "PIECE", 1000)
    cut = vectors([text])[0]
    assert whole.keys() == cut.keys() and all(abs(whole[c] - cut[c]) < 1e-12 for c in whole)


def test_a_machine_separates_and_balances():
    rng = np.random.default_rng(2)
    sign = np.where(rng.random(300) < 0.1, 1.0, -1.0)
    made = [(np.sort(rng.choice(50, 5, replace=False)) + (0 if s > 0 else 40), np.full(5, 0.44)) for s in sign]
    w = li.fit_machine(made, sign)
    margin = np.array([w[c] @ v + w[-1] for c, v in made])
    assert ((margin > 0) == (sign > 0)).mean() > 0.97


def test_second_step_compares_relatives_only():
    train = rows(200)
    made = [(np.array(sorted(v)), np.array([v[c] for c in sorted(v)])) for v in vectors([t for _, t, _ in train])]
    model = li.Hierarchy([lang for *_, lang in train], made, li.FAMILIES)
    assert model.families.names == ["germanic", "romance"]
    assert [v.names for v in model.languages] == [["de", "en"], ["es", "fr"]]
    assert len(model.families.weights) == 1 and [len(v.weights) for v in model.languages] == [1, 1]
    own = li.Hierarchy([lang for *_, lang in train], made, {"germanic": "en de"})
    assert own.families.names == ["es", "fr", "germanic"]


def test_held_out_rows_are_predicted_and_not_learned_from(spark):
    train = rows(400)
    df = spark.createDataFrame(train, SCHEMA)
    out = {r["doc_id"]: r for r in li.predict(df.repartition(3)).collect()}
    assert len(out) == 400 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [i for i, r in out.items() if r["held_out"]]
    assert 60 < len(held) < 140
    assert np.mean([out[i]["lang_pred"] == train[i][2] for i in held]) > 0.97
    # other languages on the held-out rows change nothing
    swapped = [(i, t, "xx" if out[i]["held_out"] else lang) for i, t, lang in train]
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(spark.createDataFrame(swapped, SCHEMA)).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in out.items()}


def test_the_sample_is_bounded_balanced_and_the_same_everywhere(spark):
    df = spark.createDataFrame(rows(400) + [(1000 + i, "the house and water", "en") for i in range(300)] + [rows(1)[0]] * 50, SCHEMA)
    picked = [tuple(sorted((r["lang"], r["turn"]) for r in li.training_vectors(df.repartition(n), 4, 2, 80).collect())) for n in (1, 5)]
    assert picked[0] == picked[1]
    sizes = Counter(lang for lang, _ in picked[0])
    assert set(sizes) == set(WORDS) and max(sizes.values()) == 20 and min(sizes.values()) >= 18


def test_defined_cases(spark):
    odd = [(None, "the house and water", "en"), (500, None, "en"), (501, "", "de"), (502, "12 !! --", "fr"), (503, "house", None),
           (504, "the house " * 50_000, None), (505, "das haus und wasser", None), (505, "das haus und wasser", None)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows(200) + odd], SCHEMA + ", turn int, cell string, letters double")
    out = li.predict(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[500] == got[501] == got[502] == [("und", 0.0)]
    assert got[504][0][0] == "en" and got[None][0][0] == "en" and len(got[505]) == 2 and got[505][0] == got[505][1]
    assert li.predict(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = li.predict(spark.createDataFrame([(1, "the house", None)], SCHEMA)).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
    one = li.predict(spark.createDataFrame([(i, "the house", "en") for i in range(9)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}


@pytest.mark.parametrize("part", [True, False])
def test_query_accuracy(spark, part):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op12_language_id(spark, SF).filter(F.col("held_out") == part).join(truth, "doc_id")
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count() > 0
