"""Conversation repair, whitening, URL filter; all queries of the subpackage against their SQL."""

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.llm import conversation_repair as repair
from landmosaic.llm import queries, url_filter, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@given
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


@given
@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLE_SQL))
def test_query_has_rows_for_its_table(spark, name):
    key = {"op8": "page_id", "op12": "vec_id", "op13": "page_id"}.get(name.split("_")[0], "doc_id")
    table = {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}[key]
    found = queries.QUERIES[name](spark, SF).select(key).distinct()
    assert not name.startswith("op9_") and found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count() or name.startswith("op9_") and found.count() > 0


# ---------------------------------------------------------------- conversation repair

BLANK = set(" \t\n\x0b\x0c\r")


def by_trying(rows):
    """Faults, cost, audit and turns of the cheapest edits, by trying all that cost no more than deleting everything."""
    seen, kinds = set(), []
    for role, text in rows:
        last = [c for c in text if c not in BLANK]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [2 * len(rows), "D" * len(rows), []]

    def go(i, cost, audit, out):
        if cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (cost, audit) < (best[0], best[1]):
                best[:] = [cost, audit, [f"{r}:{t}" for r, t in out]]
        else:
            (role, text), more = rows[i], 5 if kinds[i] == "truncated" else 0
            go(i + 1, cost + 2, audit + "D", out)
            if kinds[i] not in ("blank", "duplicate"):
                if role:
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*out, (r, text)])
        if len(out) < 2 * len(rows) + 2:
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return kinds, *best


def made_up(rng, most):
    return [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), rng.choice(["a.", "b!", "c", "d?", "", " \n", "e. "]) + rng.choice(["", "", "."])) for _ in range(rng.randint(0, most))]


def test_cheapest_edits_are_those_of_trying_all():
    rng, steps = random.Random(3), repair.Steps()
    for _ in range(400):
        rows = made_up(rng, 5)
        kinds, cost, audit, out = by_trying(rows)
        codes = bytes(repair.code(r[:1], {"": repair.FINE, "truncated": repair.CUT}.get(k, repair.GONE)) for (r, _), k in zip(rows, kinds, strict=True))
        got, edits = repair.cheapest(codes, steps)
        assert (got, "".join(edits).translate(repair.INITIAL_OF)) == (cost, audit)
        assert [x for e, (r, t) in zip(edits, rows, strict=True) for x in repair.lines(e, r, t)] == out


def conversations(spark, seed=5):
    """Made-up conversations with ties, null turns, roles, texts and conversations; and what is expected of each."""
    rng, table, want = random.Random(seed), [], {}
    for conv in [None, *range(12)]:
        rows = [(rng.choice([None, *range(4)]), *x) for x in made_up(rng, 6)] or [(0, "user", "a.")]
        if conv == 3:
            rows.append((1, None, None))
        table += [(conv, *r, "other") for r in rows]
        rows = [(t, " " if r is None else r, " " if s is None else s) for t, r, s in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        kinds, cost, audit, out = by_trying([r[1:] for r in rows])
        numbers = {r[0] for r in rows if r[0] is not None}
        first = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(first, first[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        want[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    rng.shuffle(table)
    return spark.createDataFrame(table, "conv_id long, turn long, role string, text string, uid string").repartition(3), want


@pytest.mark.parametrize("most_rows", [4096, 2, 0])
def test_audits_do_not_depend_on_how_a_conversation_is_parted(spark, monkeypatch, most_rows):
    monkeypatch.setattr(repair, "PACK", 2)
    monkeypatch.setattr(repair, "BLOB", 3)
    turns, want = conversations(spark)
    assert {r[0]: tuple(r[1:]) for r in repair.audited(turns, most_rows=most_rows).collect()} == want


def test_repaired_turns_are_those_of_the_digest(spark):
    turns, want = conversations(spark, 8)
    turns = turns.where("conv_id IS NOT NULL")
    said = {}
    for r in repair.repaired(turns).collect():  # in order
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() for c in want if c is not None} == {c: w[-1] for c, w in want.items() if c is not None}


def test_conversations_without_turns_and_tables_without_rows(spark):
    none = hashlib.sha256().hexdigest()
    turns = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 5, "user", "a" * 300_000, False)], "conv_id long, turn long, role string, text string, gone boolean")
    for rows in (4096, 0):
        got = {r.conv_id: tuple(r)[1:] for r in repair.audited(turns, gone=F.col("gone"), most_rows=rows).collect()}
        assert got == {1: (0, 0, 0, 0, 0, 0, "", none), 2: (0, 0, 0, 1, 0, 2, "D", none)}
    assert repair.audited(turns.limit(0)).count() == 0 and repair.repaired(turns.limit(0)).count() == 0


def test_a_giant_conversation_streams_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "PACK", 1000)
    n = 30_000  # alternating turns of one conversation, every hundredth said by the wrong side
    turns = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when((F.col("id") % 2 == 0) != (F.col("id") % 100 == 99), "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    (small,) = repair.audited(turns, most_rows=n).collect()
    (large,) = repair.audited(turns, most_rows=100).collect()
    assert small == large
    assert large.audit == "".join("R" if i % 100 == 99 else "K" for i in range(n)) and large.cost == n // 100
    assert large.repaired_sha256 == hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:t{i}." for i in range(n)).encode()).hexdigest()


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("values", [[9, 8.9, 8.8, 8.7, *np.linspace(8.6, 1, 40)], [1e6, 10, 1, 0.1, *[0.01] * 30], [3, 2, 1], [5], [5] * 6 + [1] * 4, [3, 1, *[0] * 20]])
def test_jacobi_davidson_reaches_double_precision(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))
    a = q * np.array(values) @ q.T
    a = (a + a.T) / 2
    got, u = whitening.jacobi_davidson(lambda b: a @ b, d, min(4, d))
    assert np.allclose(got, sorted(values, reverse=True)[: len(got)], rtol=0, atol=1e-13 * max(values))
    assert np.linalg.norm(a @ u - u * got, axis=0).max() < 2e-14 * max(values) and np.allclose(u.T @ u, np.eye(len(got)), atol=1e-14)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    x = np.vstack([x, x[:1].repeat(100, axis=0)])  # one vector holds a fifth of the rows
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, component int").repartition(5)
    got = whitening.whitened(rows).orderBy("vec_id", "component").toPandas()
    z = np.floor(x * 256)
    fit = np.unique(z, axis=0)
    values, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, u = values[::-1][:4], u[:, ::-1][:, :4]
    want, have = (z - fit.mean(axis=0)) @ u / np.sqrt(values), got.whitened.to_numpy().reshape(-1, 4)
    sign = np.sign((want * have).sum(axis=0))
    assert np.abs(have * sign - want).max() < 1e-10
    n, sums = len(fit), fit.sum(axis=0)
    assert (got.deviation.to_numpy()[::4] == ((n * z - sums) ** 2).sum(axis=1)).all() and set(got.n) == {n}
    assert np.allclose(got.explained[:4], values / np.trace(np.cov(fit.T, bias=True)), rtol=1e-12) and got.identity_error.max() < 1e-12


def test_whitening_of_odd_tables(spark):
    v = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [math.nan, 1.0]), (5, [3.0, 1.0]), (6, [3.0]), (7, []), (8, [None, 1.0]), (9, [math.inf, 0.0]), (None, [1.0, 2.0])]
    rows = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whitened(rows).collect()}
    assert set(got) == {1, 2, 5, None} and all(r.component == 1 and r.explained == 1 and r.deviation == 327680 and abs(abs(r.whitened) - 1) < 1e-12 for r in got.values())
    assert got[1].whitened == -got[5].whitened
    for none in (rows.where("vec_id < 3"), rows.where("vec_id = 3"), rows.limit(0)):
        assert whitening.whitened(none).count() == 0


def test_deviations_stay_exact_beyond_floats():
    fit = whitening.Fit(1_000_003, [12_345_678_901_234_567, -5], 1 << 40, 1.0, np.ones(1), np.ones((2, 1)), 0.0, 0)
    x = np.array([[1 << 40, 3], [12_345_641_864, 0]])
    want = [sum((fit.n * int(a) - s) ** 2 for a, s in zip(row, fit.sums, strict=True)) for row in x]
    assert whitening.deviations(x, fit) == [w if w < 1 << 63 else None for w in want]


# ---------------------------------------------------------------- URL filter


def plain_rule(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [None, "", "x", "http://a.NET", "http://a.NET/", "http://net/", "http://example.net/en/1", "http://EXAMPLE.net/en", "http://badexample.net/en/", "x://www.example.com/de/?q", "x://example.com/fr/", "http://a.org/fr/#x",
        "http://a.org?/fr/", "http://q?u=http://a.net/", "http://a.net:80/", "ftp://É.org/fr/é", "http://b.com/" + "a/" * 50_000, "://net/", "http:///net/"]


def test_rules_of_urls(spark):
    rows = spark.createDataFrame([(i % 9, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_filter.judged(rows).collect()), key=repr)
    assert got == sorted(((i % 9, *plain_rule(u)[:3]) for i, u in enumerate(URLS)), key=repr)
    ruled = {r.rule: r.verdict for r in url_filter.judged(rows).collect()}
    assert ruled["net/"] == "block" and ruled["example.net/en/"] == "allow" and ruled[None] in ("block", "allow")


def test_entropy(spark):
    texts = ["aabb", "", "aaaa", "abcd", "ééa", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter.entropy(F.col("t"))).collect()]
    assert np.allclose(got, [1, 0, 0, 2, 0.9182958340544896, 0])


def test_urls_with_one_label_or_none(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.net/"), (2, "http://a.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judged(rows).collect()} == {1: "block", 2: "block"}
    assert [r.verdict for r in url_filter.judged(rows.where("page_id = 1")).collect()] == ["allow"]
    assert url_filter.judged(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judged(rows, rules=(("a", "/", "block"),) * 1001)


def test_trees_tell_urls_apart_that_they_have_not_seen(spark):
    """Long query strings and many digits are bad, whatever the host; one host holds a third of all rows."""
    rng, rows = random.Random(4), []
    for i in range(3000):
        bad = rng.random() < 0.5
        host = "hot.example.com" if i % 3 == 0 else f"h{rng.randint(0, 200)}.example.{rng.choice(['com', 'org'])}"
        tail = "".join(rng.choice("0123456789" if bad and rng.random() < 0.7 else "abcdefgh") for _ in range(12))
        rows.append((i, f"http://{host}/{tail}" + ("?a=1&b=2" if bad and rng.random() < 0.9 else ""), "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, truth string")
    seen = F.col("page_id") % 4 != 0
    got = url_filter.judged(df, rules=(), label=F.when(seen, F.col("truth"))).join(df.select("page_id", "truth"), "page_id").where(~(F.col("page_id") % 4 != 0))
    assert got.agg(F.avg((F.col("verdict") == F.col("truth")).cast("double"))).first()[0] > 0.95


def test_url_filter_runs_no_python(spark):
    rows = spark.createDataFrame([(i, f"http://a{i}.{t}/{p}/{i}") for i in range(40) for t in ("net", "org", "com") for p in ("fr", "en")], "page_id long, url string")
    plan = url_filter.judged(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
