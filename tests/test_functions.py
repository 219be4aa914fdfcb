"""Small cases worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordia.functions import codebleu, diffs, edits, stats, text, vectors
from accordia.operators import patches
from accordia.sources import files

DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n keep\n-old\n+new\n\\ No newline at end of file\n"


def test_diff():
    assert diffs.parse(DIFF) == [("x.py", "old", "new")]
    gone = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n--- b\n+++ c\n"
    assert diffs.parse(gone)[0][:2] == ("x.py", "a")
    assert diffs.parse('diff --git "a/a b.py" "b/a b.py"\n') == [("a b.py", "", "")]
    assert diffs.parse(None) == diffs.parse("  \n") == []
    assert diffs.parse("diff --git a/o.py b/n.py\nrename from o.py\nrename to n.py\n@@ @@\n+x\n+y\n@@ @@\n-z") == [("n.py", "z", "x\ny")]


def test_edits():
    wrong = "<edits><edit><file>a.py</file><replace_this>\nA\n</with_this>\n<with_this>\nB\n</with_this></edit></edits><edits><edit><file>b</file><replace_this>x</replace_this><with_this>y</with_this></edit></edits>"
    assert edits.extract(wrong) == [("a.py", "A", "B")]
    assert edits.extract("<replace_this>A") == [] and edits.extract(None) == []
    bare = "<edit><file> c.py </file><replace_this>1</replace_this><with_this></with_this></edit>"
    assert edits.extract(bare) == [("c.py", "1", "")]


def test_edit_places():
    body = "class A:\n    def f(self):\n        return 1\n    def g(self):\n        return 2\n"
    out, kind = edits.apply(body, "def f(self):\n    return 1", "def f(self):\n    return 3")
    assert kind == "full indentation-insensitive match" and "        return 3\n" in out
    with pytest.raises(ValueError, match="ambiguous"):
        edits.apply("a\na\n", "a", "b")
    with pytest.raises(ValueError, match="no change"):
        edits.apply("a\nb\n", "a", "a")
    out, kind = edits.apply("x = 1\ny = 2\nmiddle\nz = 3\n", "x = 1\ny = 5\nz = 3", "w = 0")
    assert kind.startswith("first/last anchor match") and out == "w = 0\n"
    out, kind = edits.apply("  start\n  b\n", "start\nq", "n")
    assert kind == "first line matching" and out == "  n\n"
    assert edits.apply("a\r\n  b c\r\n", "b  c".replace("  ", " "), "d")[0] == "a\r\n  d\r\n"
    assert edits.extract("<edit><file>a</file><replace_this>  \nA\n  </replace_this><with_this>\n\n B\n</edit>") == [("a", "A", "\n B")]
    assert edits.apply("if x:\n    return 1\n", "    return 1", "  return 2\n  y")[0] == "if x:\n    return 2\n    y\n"
    assert edits.apply("a\nb\nc\n", "b", "")[0] == "a\n\nc\n" and edits.apply("a\n\tb\nc\n", " b\n", "")[0] == "a\nc\n"
    for text, old in (("a\nb\na\nb\n", " a\n b"), ("x\ny\n", "q"), ("a\n1\n2\n3\n4\n5\nz\n", "a\n7\n8\nz"), ("  a\n1\n  a\n2\n", "a\n9"), ("t", "\n")):
        with pytest.raises(ValueError):
            edits.apply(text, old, "new")
    assert edits.spaced("a\nb") == "a\n\nb\n"
    assert diffs.parse(edits.fallback_diff([("f.py", "same", "same")])) != []
    assert diffs.parse(edits.unified("f.py", "a\n", "b\n")) == [("f.py", "a", "b")]


def test_syntax():
    assert edits.syntax("a.py", "x = 1") == 1 and edits.syntax("a.py", "x =") == 0
    assert edits.syntax("a.json", '{"a": 1}') == 1 and edits.syntax("a.json", "{") == 0
    assert edits.syntax("a.toml", "a = 1") == 1 and edits.syntax("a.xml", "<a>") == 0
    assert edits.syntax("a.yaml", "a: [1, 2]\n---\nb: !x 3\n") == 1 and edits.syntax("b.yml", "a: [1\nb: }") == 0
    assert edits.syntax("a.zig", "???") == 1 and edits.syntax(None, None) == 1


def bleu(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = patches.with_grams(patches.with_grams(df, "a", "x"), "b", "y")
    return patches.channel(df, "x", "y", "s", "1D").first().s


def test_bleu(spark):
    assert bleu(spark, "one", "one") == round(0.1**0.75, 6)
    assert bleu(spark, "a b c d", "a b c d") == 1.0
    assert bleu(spark, "a b", "c d") == 0.0 and bleu(spark, "", " ") == 1.0 and bleu(spark, "a", "") == 0.0

    def one(c, r):
        m = [sum(min(c_.count(g), r_.count(g)) for g in set(c_)) for c_, r_ in (([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (c, r)) for n in range(1, 5))]
        if not m[0]:
            return 0.0
        p = [(v or 0.1) / max(1, len(c) - n) for n, v in enumerate(m)]
        return (1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(sum(map(math.log, p)) / 4)

    rng = np.random.default_rng(1)
    for _ in range(6):
        c, r = (list(map(str, rng.integers(0, 4, rng.integers(1, 12)))) for _ in range(2))
        assert bleu(spark, " ".join(c), " ".join(r)) == pytest.approx((one(c, r) + one(r, c)) / 2, abs=1e-6)


def test_decomposition(spark):
    same = "a b c d"
    rows = [(1, 0, "f", same, ""), (1, 0, "g", "x", "y"), (1, 1, "f", same, ""), (1, 1, "h", "x", "y"), (1, 2, "k", "q", "")]
    got = {(r.i, r.j): r for r in patches.decomposition(spark.createDataFrame(rows, "issue int, t int, file string, removed string, added string")).collect()}
    assert got[0, 1].main == pytest.approx(1 / 3) and got[0, 1].jaccard == pytest.approx(1 / 3) and got[0, 1].shared_only == 1.0
    assert got[0, 2].main == 0 and got[0, 2].shared_only == 0
    for r in got.values():
        assert r.main == pytest.approx(r.jaccard * r.shared_only, rel=1e-10, abs=1e-12)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0])], "a array<double>, z array<double>, b array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("uz"), vectors.calibrated(F.lit(0.6)).alias("e")).first()
    assert r.c == pytest.approx(1) and r.n == 0 and r.u == [0.6, 0.8] and r.uz == [0, 0] and r.e == pytest.approx(0.449329, abs=1e-6)
    toks = spark.createDataFrame([(list("abcdefg"),), ([],)], "t array<string>")
    parts = [x.p for x in toks.select(vectors.even_chunks(F.col("t"), 3).alias("p")).collect()]
    assert [len(p) for p in parts[0]] == [2, 2, 3] and sum(parts[0], []) == list("abcdefg") and parts[1] == []
    assert "".join(vectors.greedy_chunks("ab\ncd ef", 4, len)) == "ab\ncd ef"
    assert list(vectors.request_batches([("a", 3), ("b", 3), ("c", 9), ("d", 1)], 2, 6)) == [[("a", 3), ("b", 3)], [("c", 9)], [("d", 1)]]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.PY",), ("a.b/c",), (".gitignore",), ("x/README.md",)], "p string")
    assert [r.e for r in df.select(diffs.extension(F.col("p")).alias("e")).collect()] == ["py", "[no extension]", "[no extension]", "md"]
    assert [r.s for r in df.select(diffs.is_source(F.col("p")).alias("s")).collect()] == [True, True, True, False]
    bad = spark.createDataFrame([("/etc/x",), ("../y",), ("a/../b",), ("ok/z..py",)], "p string")
    assert [r.s for r in bad.select(diffs.is_safe(F.col("p")).alias("s")).collect()] == [False, False, False, True]


def test_codebleu():
    same = "def f(a):\n    b = a + 1\n    return b\n"
    assert codebleu.score(same, same) == pytest.approx(1.0)
    assert codebleu.score(same, "x y z", "go") == 0.0
    assert 0 < codebleu.score(same, same.replace("b", "c")) < 1


def test_bootstrap():
    v = np.arange(10.0)
    assert stats.interval(v, 1) == stats.interval(v, 1) and stats.interval(v[:1], 1) == (None, None)
    low, high = stats.interval(v, 1)
    assert low < v.mean() < high


def test_sources(spark, tmp_path):
    top = tmp_path / "out" / "m1" / "i7"
    top.mkdir(parents=True)
    (top / "Replacement_Temp_0.3_oracle.txt").write_text("body\nmore")
    (top / "p.jsonl").write_text('\n{"instance_id": "i7", "model_patch": "x"}\n{"instance_id": "no"}\n')
    got = files.whole_texts(spark, f"{tmp_path}/out/*/*/*.txt", r"/([^/]+)/([^/]+)/Replacement_Temp_([0-9.]+)_", "model", "instance_id", "temp").first()
    assert (got.model, got.instance_id, got.temp, got.text) == ("m1", "i7", "0.3", "body\nmore")
    row = files.first_json_objects(spark, f"{tmp_path}/out/*/*/*.jsonl", "instance_id string, model_patch string").first()
    assert (row.instance_id, row.model_patch) == ("i7", "x")
    df = spark.createDataFrame([("11", None), ("7|3|1", 2.5)], "pattern string, v double")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.string_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [("11", "NA"), ("7|3|1", "2.5")]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(json.loads(r.value)["pattern"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ["11", "7|3|1"]
    assert files.first_column(df, "nope", "v") == "v"
    pairs = spark.createDataFrame([("i", 0, 1, 0.5)], "issue string, i int, j int, score double")
    files.write_matrix(pairs, str(tmp_path / "m"), ["issue"])
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_text_of_nothing(spark):
    r = spark.sql(f"SELECT {text.tokens('NULL')} AS a, {text.tokens(chr(39) + '  ' + chr(39))} AS b").first()
    assert r.a == [] and r.b == []


def test_resumable_ingest(spark, tmp_path):
    from accordia.streaming.ingest import ingest, latest_cells

    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    for k in range(2):
        spark.createDataFrame([(1, k, f"s{k}"), (2 + k, k, "x")], "key int, at int, status string").coalesce(1).write.mode("append").parquet(src)
        rows = ingest(spark, src, "*.parquet", "key int, at int, status string", table, mark)
        assert rows.count() == 2 * (k + 1)
    assert latest_cells(rows, ["key"], "at").where("key = 1").first().status == "s1"


def test_conversion(spark):
    from accordia.operators import conversion

    edit = "<edits><edit><file>{}</file><replace_this>{}</replace_this><with_this>{}</with_this></edit></edits>"
    src = {"a.py": "x = 1\ny = 2\n"}
    patch, status, kinds = conversion.convert(edit.format("a.py", "x = 1", "x = 3"), src)
    assert diffs.parse(patch) == [("a.py", "x = 1", "x = 3")] and (status, kinds) == ("1", "exact string match")
    assert conversion.convert(edit.format("a.py", "x = 1", "x = ("), src)[1] == "0"
    patch, status, _ = conversion.convert(edit.format("gone.py", "x", "y"), src)
    assert status == conversion.FALLBACK and diffs.parse(patch) == [("gone.py", "x", "y")]
    assert conversion.convert(edit.format("../a.py", "x", "y"), {"../a.py": "x"})[1] == conversion.FALLBACK
    assert conversion.convert("no edits", src)[1] == "ERROR" and conversion.convert(None, src)[1] == "MISSING"
    assert conversion.convert(edit.format("a.py", "x = 1", "x = 1"), src)[1] == "1"
    answers = spark.createDataFrame([("i", 0, edit.format("a.py", "x = 1", "x = 3")), ("i", 1, None)], "issue string, t int, answer string")
    sources = spark.createDataFrame([("i", "a.py", src["a.py"])], "issue string, path string, content string")
    r = conversion.totals(conversion.predictions(answers, sources)).first()
    assert (r.converted, r.fallbacks, r.failed, r.exact) == (1, 0, 1, 1)


def test_embedding_cache(spark):
    from accordia.operators import embedding

    rows = [(1, 0, "f", "a b", ""), (1, 1, "f", "a b", "c"), (1, 1, "g", "", "x")]
    df = spark.createDataFrame(rows, "issue int, t int, file string, removed string, added string")
    files_, new = embedding.channel_vectors(df, embedding.Hashing(16), "v")
    assert new.count() == 3 and files_.count() == 3
    r = embedding.decomposition(files_).first()
    assert r.jaccard == 0.5 and r.raw == pytest.approx(0.25) and r.main == pytest.approx(math.exp(-1) / 2)
    again, more = embedding.channel_vectors(df, embedding.Hashing(16), "v", new)
    assert more.count() == 0 and again.where("r IS NOT NULL").count() == 2


def test_embedded_texts_are_neither_joined_nor_shuffled_as_vectors(spark):
    from accordia.operators import embedding

    rows = [(1, 0, "f", "a b", ""), (1, 1, "f", "a b c", None), (1, 2, "f", " ", "x y"), (1, 2, "g", "q", "a b"), (1, 3, "g", "a", "a b"), (1, 4, None, "a", "b"), (2, 0, "f", "a", "b"), (None, 0, "f", "a", "b"), (None, 1, "f", "a", "b"), (3, 5, "f", "z", "\t"), (3, 6, "f", "z", "\t")]
    df = spark.createDataFrame(rows, "issue int, t int, file string, removed string, added string")
    got = embedding.text_decomposition(df, embedding.Hashing(16))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    vec = dict(zip(texts := ["a b", "a b c", "x y", "q", "a"], embedding.Hashing(16).embed(texts), strict=True))
    dot = lambda x, y: max(-1.0, min(1.0, sum(a * b for a, b in zip(vec[x], vec[y], strict=True))))
    want = {(1, 0, 1): dot("a b", "a b c"), (1, 0, 2): 0.0, (1, 1, 2): 0.0, (1, 2, 3): (dot("q", "a") + 1) / 2 / 2, (3, 5, 6): 0.5}
    raw = {(r.issue, r.i, r.j): r.raw for r in got.collect()}
    for k, x in want.items():
        assert raw[k] == pytest.approx(x / (2 if k == (1, 0, 2) or k == (1, 1, 2) else 1)), k
    assert len(raw) == 11 and raw[1, 0, 4] == 0.0 and not any(k[0] in (None, 2) for k in raw)
    files_, _ = embedding.channel_vectors(df, embedding.Hashing(16), "v")
    assert {(r.issue, r.i, r.j): pytest.approx(r.raw) for r in embedding.decomposition(files_).collect()} == raw


def test_models(spark):
    from accordia.sources import models

    calls, waits = [], []

    def flaky(prompt, temperature, room):
        calls.append(room)
        if len(calls) < 3:
            raise RuntimeError("503 overloaded")
        return "done"

    assert models.ask(flaky, "p" * 400_000, 0.1, sleep=waits.append) == ("done", None) and calls == [10_000] * 3 and 2 <= waits[0] <= 4 <= waits[1] <= 6
    assert models.ask(lambda *a: 1 / 0, "p", 0.1, sleep=waits.append)[1].startswith("ZeroDivisionError") and len(waits) == 2
    assert not models.retryable("402 connection", "hosted") and models.retryable("Timed out")

    class Status(Exception):
        status_code = 409

    assert models.retryable(Status("value 1500"), "status") and not models.retryable("value 1500", "status") and not models.retryable(Status("no"), "hosted")
    prompts = spark.createDataFrame([("i", "hello")], "issue string, text string")
    got = models.answers(prompts, lambda: lambda p, t, room: f"{p} {t}").orderBy("t").collect()
    assert len(got) == 11 and got[3].answer == "hello 0.3"
