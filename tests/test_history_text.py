from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import history as H
from tracewright.operators import similarity as S
from tracewright.operators import text as X


def test_off_hours(spark):
    times = {"14:00": False, "03:00": True, "23:00": True, "22:59": False, "06:00": False, "05:59": True}
    df = spark.createDataFrame([(k, datetime.fromisoformat(f"2024-01-01 {k}:00")) for k in times], "k string, ts timestamp")
    assert {r["k"] for r in H.off_hours(df).collect()} == {k for k, v in times.items() if v}


def test_sensitive_deletions(spark):
    paths = [".env", "config/secrets.yaml", "private.key", "id_rsa", "README.md", "main.rs"]
    df = spark.createDataFrame([("h", p, "D") for p in paths], "hash string, path string, status string")
    assert sorted(r["path"] for r in H.sensitive_deletions(df).collect()) == sorted(paths[:4])


def test_population_deviation(spark):
    days = [(f"2024-01-{d:02d}", n) for d, n in zip(range(1, 11), range(1, 11), strict=True)]
    rows = [("r", datetime.fromisoformat(d)) for d, n in days for _ in range(n)]
    df = spark.createDataFrame(rows, "repo string, ts timestamp")
    out = H.busy_days(df, sigma=1, floor=0).collect()
    assert sorted(str(r["day"]) for r in out) == ["2024-01-09", "2024-01-10"]
    assert out[0]["threshold"] == pytest.approx(5.5 + 2.8722813232690143)
    assert H.busy_days(df.limit(9), sigma=0, floor=0).count() == 0


def test_messages_branches_emails(spark):
    msg = spark.createDataFrame([("r", "1", "fix Backdoor"), ("r", "2", "Remove old password"), ("r", "3", "add docs")], "repo string, hash string, message string")
    assert sorted((r["evidence"]["commit_hash"], r["severity"]) for r in H.suspicious_messages(msg).collect()) == [("1", "high"), ("2", "medium")]
    br = spark.createDataFrame([("r", "temp/x", "c"), ("r", "main", "c")], "repo string, name string, last_commit string")
    assert [r["evidence"]["branch_name"] for r in H.suspicious_branches(br).collect()] == ["temp/x"]
    em = spark.createDataFrame([("a@Mailinator.com",), ("No-Reply@x.y",), ("bob@x.y",)], "email string")
    assert H.suspicious_email(em).count() == 2


def test_latest_commits_prefilters_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("repo"), F.col("id").cast("string").alias("hash"), F.timestamp_seconds("id").alias("ts"))
    out = H.latest_commits(df, 7)
    assert sorted(int(r["hash"]) for r in out.collect()) == list(range(986, 1000))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_commit_graph(spark):
    df = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("d", ["x"]), ("e", ["x", "y"])], "hash string, parents array<string>")
    got = {r["hash"]: (r["kind"], r["missing_parents"]) for r in H.commit_graph(df).collect()}
    assert got == {"a": ("root", 0), "b": ("linear", 0), "c": ("merge", 0), "d": ("linear", 1), "e": ("merge", 2)}


def test_size_outlier(spark):
    df = spark.createDataFrame([("j", f"f{i}", 1024) for i in range(10)] + [("j", "big", 100 * 1024 * 1024)], "job_id string, path string, size_bytes long")
    assert [r["path"] for r in X.size_outliers(df).collect()] == ["big"]
    assert [r["path"] for r in X.global_size_outliers(df).collect()] == ["big"]


def chunks_of(spark, language, text):
    df = spark.createDataFrame([("p", language, text)], "path string, language string, content string")
    return sorted((r["start_line"], r["end_line"], r["content"]) for r in X.chunk_code(df).collect())


def test_chunkers(spark):
    code = "use x;\nfn a() {\n  b();\n}\n\nfn c() {\n d() }\ntail"
    assert chunks_of(spark, "rust", code) == [(2, 4, "fn a() {\n  b();\n}"), (6, 7, "fn c() {\n d() }")]
    py = "import os\ndef f(x):\n    return x\n# note\ny = 1\nclass A:\n    z = 2\n"
    assert chunks_of(spark, "python", py) == [(2, 4, "def f(x):\n    return x\n# note"), (6, 7, "class A:\n    z = 2")]
    text = "\n".join(str(i) for i in range(120))
    assert [(s, e) for s, e, _ in chunks_of(spark, "text", text)] == [(1, 50), (51, 100), (101, 120)]
    assert chunks_of(spark, "text", "") == []
    assert [(s, e) for s, e, _ in chunks_of(spark, "python", "def a():\n    x = 1\ndef b():\n    y = 2")] == [(1, 2), (3, 4)]
    assert [(s, e) for s, e, _ in chunks_of(spark, "python", "class A:\n    def a(self):\n        x = 1\n    def b(self):\n        y = 2\nz = 1")] == [(1, 1), (2, 3), (4, 5)]
    assert [(s, e) for s, e, _ in chunks_of(spark, "go", "func a() {\n x\nfunc b() {\n}\n")] == [(1, 2), (3, 4)]


def test_text_features(spark):
    rows = [("a", "Good great bad function class"), ("b", "nothing"), ("c", "mail x.y@z.com see https://h.com/q, bye")]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("file_type", F.lit("text"))
    s = {r["id"]: r["sentiment"] for r in X.sentiment(df).collect()}
    assert s["a"] == pytest.approx(1 / 3) and s["b"] == 0
    assert X.concepts(df).where("id = 'a'").first()["concepts"] == ["function", "class"]
    assert [(r["kind"], r["entity"]) for r in X.entities(df).orderBy("position").collect()] == [("email", "x.y@z.com"), ("url", "https://h.com/q,")]
    assert {r["id"]: r["content_type"] for r in X.content_type(df).collect()} == {"a": "code", "b": "text", "c": "text"}
    assert {r["id"]: r["intent"] for r in X.intent(df).collect()} == {"a": "benign", "b": "benign", "c": "benign"}


def test_embedding_is_unit_and_stable(spark):
    text = "alpha beta gamma alpha " * 5
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, "short")], "id int, content string")
    out = {r["id"]: np.array(r["embedding"]) for r in X.embed_text(df, 64, min_bytes=50).collect()}
    assert set(out) == {1, 2} and np.allclose(out[1], out[2]) and np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-5)


def clustered(n=300, dim=12, seed=3):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(8, dim))
    v = centers[rnd.integers(0, 8, n)] + rnd.normal(scale=0.15, size=(n, dim))
    v[n // 2:n // 2 + 80] = v[0]  # a group of copies
    v[5] = 0
    return v.astype("float32")


@pytest.fixture(scope="module")
def vectors(spark):
    v = clustered()
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, embedding array<float>")


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
def test_similar_pairs_equal_brute_force(vectors, block_rows):
    v, df = vectors
    seen, reps = {}, []
    for i, row in enumerate(v):
        key = row.tobytes()
        if key not in seen:
            seen[key] = [i, 0]
            reps.append(i)
        seen[key][1] += 1
    unit = {i: v[i].astype("float64") / np.linalg.norm(v[i]) for i in reps if np.linalg.norm(v[i]) > 0}
    want = {}
    for x, a in enumerate(reps):
        for b in reps[x + 1:]:
            if a in unit and b in unit and unit[a] @ unit[b] > 0.9:
                want[(a, b)] = (seen[v[a].tobytes()][1], seen[v[b].tobytes()][1])
    got = S.similar_pairs(df, 0.9, block_rows).collect()
    assert len(got) == len(want)
    assert {(r["id_a"], r["id_b"]): (r["copies_a"], r["copies_b"]) for r in got} == want


def test_copies(vectors):
    v, df = vectors
    got = {(r["representative"], r["id"]) for r in S.copies_of(df).collect()}
    assert got == {(0, 0)} | {(0, i) for i in range(150, 230)}


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_knn_equals_brute_force(vectors, block_rows):
    v, df = vectors
    keep = [i for i in range(len(v)) if np.linalg.norm(v[i]) > 0]
    u = np.array([v[i] / np.linalg.norm(v[i].astype("float64")) for i in keep])
    scores = np.round(u @ u.T, 12)
    got = {}
    for r in S.knn_join(df, df, 4, block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    for x, i in enumerate(keep):
        best = sorted((s for y, s in enumerate(scores[x]) if y != x), reverse=True)[:4]
        assert [s for _, s in sorted(got[i])] == pytest.approx(best, abs=1e-9)


def test_external_and_exact_matches(spark, vectors):
    v, df = vectors
    corpus = df.where("id < 20").withColumn("risk_level", F.lit("high"))
    mine = df.where("id >= 20")
    got = {(r["query_id"], r["corpus_id"]) for r in S.external_matches(mine, corpus, 0.95, 16).collect()}
    want = set()
    first = {}
    for i in range(20, len(v)):
        first.setdefault(v[i].tobytes(), i)
    for i in first.values():
        for c in range(20):
            a, b = v[i].astype("float64"), v[c].astype("float64")
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if n and a @ b / n >= 0.95:
                want.add((i, c))
    assert got == want
    files = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, content string")
    known = spark.createDataFrame([(9, "x")], "id long, content string")
    assert [(r["copies"], r["first_id"], r["corpus_id"]) for r in S.exact_matches(files, known).collect()] == [(2, 1, 9)]


def test_chunk_pairs_skip_one_file(spark):
    rows = [(1, "f", "py", 60, [1.0, 0.0]), (2, "f", "py", 60, [1.0, 0.1]), (3, "g", "py", 60, [1.0, 0.05]), (4, "h", "go", 60, [1.0, 0.0]), (5, "i", "py", 10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, file string, language string, bytes int, embedding array<float>")
    assert sorted((r["id_a"], r["id_b"]) for r in S.similar_chunks(df, min_bytes=50).collect()) == [(1, 3), (2, 3)]


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0, 1.0], [2.0, 2.0])], "i int, a array<float>, b array<float>")
    got = {r["i"]: r["c"] for r in df.select("i", S.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == pytest.approx(1.0)


def test_search_snippet(spark):
    df = spark.createDataFrame([(1, "one Token two token"), (2, "none"), (3, "a.b token")], "id long, content string")
    out = S.search_text(df, ["token", "a.b"], limit=5).collect()
    assert [(r["id"], r["score"]) for r in out] == [(1, 2), (3, 2)]
    assert out[0]["snippet"] == "one <mark>Token</mark> two <mark>token</mark>"
