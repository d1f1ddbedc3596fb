import numpy as np

from loomwork.llm import quality_bayes as qb


def test_accuracy_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = qb.op8_quality_bayes(spark, sf).toPandas()
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(out) == docs.count() and out.quality.between(0, 1).all()
    both = out.merge(lab, on="doc_id", suffixes=("", "_label"))
    assert ((both.quality >= 0.5) == (both.quality_label == 1)).mean() > 0.93


def test_accuracy_on_labels_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = qb.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("crc32(cast(doc_id as string)) % 4 <> 2")).toPandas()
    held = labels.where("quality is not null and crc32(cast(doc_id as string)) % 4 = 2").toPandas()
    both = out.merge(held, left_on="id", right_on="doc_id", suffixes=("", "_label"))
    right = ((both.quality >= 0.5) == (both.quality_label == 1)).mean()
    print(f"held-out accuracy {right:.4f} on {len(both)} rows, share of ones {both.quality_label.mean():.4f}")
    assert len(both) > 100 and right > 0.9


def test_logistic_model_generalises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=800) * 0.3 > 0).astype(float)
    m = qb.fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.93


def test_sites_shrink(spark):
    good, bad = "plain words in a calm line of text here", "SHOUT!! LOUD!! NOISE!! MORE!! ### $$$"
    rows = [(i, good if i % 2 else bad, "mixed", "p") for i in range(200)]
    rows += [(1000 + i, bad, "badhost", "p") for i in range(200)] + [(5000, bad, "tiny", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, quality int")
    out = {r.id: r for r in qb.classify(docs, labels).collect()}
    mean = sum(r.doc_score for r in out.values()) / len(out)
    assert abs(out[5000].host_score - mean) < abs(out[1000].host_score - mean)
    assert out[1000].host_score < 0.1 < out[0].host_score and out[1].keep and not out[0].keep


def test_defined_results(spark):
    rows = [(1, None, None, None, "x"), (2, "", "s", None, "x"), (3, "word " * 200000, "s", "p", "x"), (3, "word", "s", "p", "x"), (None, "q", "s", "p", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = qb.classify(docs, labels).toPandas()
    assert len(out) == 5 and np.isfinite(out.quality).all()
    assert qb.classify(docs.limit(0), labels).count() == 0


def test_posteriors_worked_out_again(spark):
    """Host, path and document scores recomputed with numpy from the document evidence."""
    r = np.random.default_rng(5)
    good, bad = "the house on the hill has a long and quiet garden with old trees . ", "zz 11 ## $$ xx qq "
    rows = []
    for i in range(240):
        host = ["a", "b", "c", None][i % 4]
        fine = r.random() < {"a": 0.9, "b": 0.4, "c": 0.1, None: 0.5}[host]
        rows.append((i, (good if fine else bad) * int(r.integers(2, 6)), host, ["x", "y", None][i % 3], int(fine)))
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(x[0], x[4]) for x in rows if x[0] % 2], "doc_id long, quality int")
    out = qb.classify(docs, labels).toPandas().set_index("id").sort_index()
    p = out.doc_score.to_numpy()
    host = [x[2] for x in rows]
    site = [(x[2], x[3]) for x in rows]
    groups = lambda keys: {k: np.array([i for i, x in enumerate(keys) if x == k]) for k in set(keys)}

    def strength(by, prior):
        n = {k: len(v) for k, v in by.items()}
        total = sum(n.values())
        between = sum(n[k] * (p[v].mean() - prior[k]) ** 2 for k, v in by.items())
        level = sum(n[k] * prior[k] * (1 - prior[k]) for k in by) / total
        tau2 = (between - len(by) * level) / (total - sum(x**2 for x in n.values()) / total)
        return np.clip(level / tau2 - 1, 1, 1e6) if tau2 > 0 else 1e6

    base = p.mean()
    hosts = groups(host)
    s = strength(hosts, dict.fromkeys(hosts, base))
    host_post = {k: (p[v].sum() + s * base) / (len(v) + s) for k, v in hosts.items()}
    sites = groups(site)
    prior = {k: host_post[k[0]] for k in sites}
    s = strength(sites, prior)
    site_post = {k: (p[v].sum() + s * prior[k]) / (len(v) + s) for k, v in sites.items()}
    odds = lambda x: np.log(x / (1 - x))
    for i in range(len(rows)):
        assert abs(out.host_score[i] - host_post[host[i]]) < 1e-9 and abs(out.path_score[i] - site_post[site[i]]) < 1e-9
        clipped = min(max(p[i], 1e-9), 1 - 1e-9)
        want = 1 / (1 + np.exp(-(odds(clipped) + odds(site_post[site[i]]) - odds(base))))
        assert abs(out.quality[i] - want) < 1e-6


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text here", "a", "x", 5, 6, 7)], "doc_id long, text string, source string, lang string, source_text int, features int, host int")
    out = qb.with_features(docs.drop("features"))
    assert out.columns == ["doc_id", "source", "lang", "source_text", "host", "features"] and out.count() == 1
