import corpus_pipeline
from accordia.llm import langid, packing, quality
from accordia.llm.bpe import encoder
from tests.llm.test_neardup import brute


def test_run_against_plain_version(spark, sf, docs, local):
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 9))
    names = [x.split()[0] for x in f"{quality.BASE}, {quality.STATS}".split(", ")]
    seen = {i: dict(zip(names, quality.measure(d.text), strict=True)) for i, d in local.items()}
    passed = {i for i, m in seen.items() if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]}
    hit = lambda m, name, side, c: m[name] > c if side == "+" else m[name] < c
    risk = quality.Risk()
    tunes = lambda i: i % 1_000_003 * 7919 % 1_000_003 % 10 < risk.tuning
    held = {i for i in passed if i in labels}
    strata, lost, totals, chosen = {local[i].lang for i in held}, {}, {}, {}
    for s in strata:
        own = [(seen[i], labels[i] > 0) for i in held if local[i].lang == s and tunes(i)]
        chosen[s] = quality.choose({(n, side): [(sum(g and hit(m, n, side, c) for m, g in own), sum(not g and hit(m, n, side, c) for m, g in own)) for c in cuts] for (n, side), cuts in quality.RULES.items()}, risk)
        good = [seen[i] for i in held if local[i].lang == s and not tunes(i) and labels[i] > 0]
        totals[s] = len(good)
        lost[s] = [sum(any(hit(m, *r, c) for r, c in chosen[s][: k + 1]) for m in good) for k in range(len(chosen[s]))]
    used = quality.certify(lost, totals, risk, len(strata))
    kept = {i for i in passed if not any(hit(seen[i], *r, c) for r, c in chosen.get(local[i].lang, [])[: used.get(local[i].lang, 0)])}
    model = langid.fit(docs.where(docs.doc_id.isin([int(i) for i in kept])))
    got = dict(zip(kept, langid.predict(model, [local[i].text for i in kept]), strict=True))
    kept = [i for i in kept if got[i][0] != "und" and got[i][1] >= 0.4]
    rows = [(i, local[i].text) for i in sorted(kept)]
    kept = {i for (i, _), c in zip(rows, brute(rows), strict=True) if i == c}
    e = encoder(packing.TOKENIZER)
    want = {(i, k) for i in kept for k in range(-(-(len(e.whole(local[i].text)) // 4 + 1) // packing.ROOM))}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece) for r in pieces} == want and len(pieces) == len(want)


def test_stages_keep_the_columns(spark, sf, docs):
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "best-fit packing"]
