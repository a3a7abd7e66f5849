"""Vector codes against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from graphloom.llm import vector_codes
from graphloom.llm.queries import ORACLES, QUERIES
from graphloom.llm.vector_codes import Heaps, Params, encode, squared_distances, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes and errors by id, and the digest; ``rows`` are (id, vector, label)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda p, v: min((dist(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(assign(p, v)[1], []).append(cut(v, p))
            for j, members in of.items():
                books[p][j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, lab, "".join(f"{assign(p, v)[1]:02x}" for p in range(parts)), sum(assign(p, v)[0] for p in range(parts))) for i, v, lab in kept]
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def as_rows(df):
    rows = df.collect()
    return sorted([(r["vec_id"], r["label"], r["code"], r["error"]) for r in rows], key=str), {r["codebooks_sha256"] for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table_by_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.sql(ORACLES["op12_vector_codes"])
    names = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, QUERIES["op12_vector_codes"](spark, f"/root/testdata/{sf}").select(*names).collect())) == sorted(want.select(*names).fetchall())


def test_few_entries_many_rounds_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) + 3 * (i % 7)], i % 3 if i % 5 else None) for i in range(700)]
    work = []
    got = encode(spark.createDataFrame(rows, SCHEMA), Params(entries=9, rounds=6, block_rows=64), work=work)
    want, digest = plain([(i, np.array(v, np.float32).tolist(), x) for i, v, x in rows], entries=9, rounds=6)
    assert as_rows(got) == (want, {digest})
    assert work[0] == 2800 and work[-1] < 1400 and all(w <= 2800 for w in work)  # later rounds look at fewer
    errors = {}
    for _, lab, _, e in want:
        errors[lab] = errors.get(lab, 0) + e
    for limit in (100, 0):  # broadcast and joined
        summed = with_label_error(got, Params(broadcast_labels=limit)).collect()
        assert len(summed) == 700 and all(r["label_error"] == errors[r["label"]] for r in summed)


def test_ties_repeats_and_unsound_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in np.unravel_index(i % 16, (2, 2, 2, 2))], 1) for i in range(60)]
    rows += [(7, [0.0, 1.0, 0.0, 1.0], 2), (None, [1.0, 1.0, 1.0, 1.0], None), (100, None, 1), (101, [nan, 0.0, 0.0, 0.0], 1), (102, [0.0, inf, 0.0, 0.0], 1), (103, [0.0, None, 0.0, 0.0], 1)]
    got = encode(spark.createDataFrame(rows, SCHEMA), Params(entries=5))
    want, digest = plain(rows, entries=5)
    assert as_rows(got) == (want, {digest}) and len(want) == 62


def test_other_lengths_stay_without_codes(spark):
    rows = [(1, [1.0] * 4, 0), (2, [2.0] * 4, 0), (3, [1.0] * 3, 0), (4, [], 0), (5, [0.5] * 8, 0)]
    got, _ = as_rows(encode(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(1, 0, "00000000", 0), (2, 0, "01010101", 0), (3, 0, None, None), (4, 0, None, None), (5, 0, None, None)]


def test_empty_tables_and_clashing_names(spark):
    assert encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert with_label_error(encode(spark.createDataFrame([(1, None, 3)], SCHEMA))).count() == 0
    wide = spark.createDataFrame([(1, [1.0] * 4, "a", "x", 5)], "vec_id long, embedding array<double>, label string, code string, error int")
    assert with_label_error(encode(wide)).columns == ["vec_id", "label", "code", "error", "codebooks_sha256", "label_error"]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="or more in size"):
        encode(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 1)], SCHEMA)).count()


def test_distances_of_large_numbers_are_exact():
    x, c = np.array([[2**27 + 1, -(2**27)]]), np.array([[-(2**27), 2**27 - 1], [1, 2]])
    assert squared_distances(x, c).tolist() == [[(2**28 + 1) ** 2 + (2**28 - 1) ** 2, (2**27) ** 2 + (2**27 + 2) ** 2]]


def test_heaps_pop_what_the_drift_has_passed():
    rng = np.random.default_rng(5)
    entry, key, drift = rng.integers(0, 6, 500), rng.random(500), rng.random(6)
    assert sorted(Heaps(entry, key, 6).popped(drift)) == np.flatnonzero(key <= drift[entry]).tolist()


def test_bounds_hold_as_entries_drift():
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (400, 16))
    book = vector_codes.Book(x[:20][None].copy(), np.zeros((1, 20)))
    entry, key = vector_codes.scanned(x, book, 0)
    for _ in range(8):
        entries = book.entries + rng.integers(-3, 4, book.entries.shape)
        step = np.sqrt(((entries - book.entries) ** 2).sum(2))
        book = vector_codes.Book(entries, book.drift + step + step.max())
        looked = vector_codes.reassigned(x, entry, key, book, 0)
        assert len(looked) < 400
        assert (entry == squared_distances(x, entries[0]).argmin(1)).all()
