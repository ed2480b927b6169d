"""Operators on inputs that the test tables don't have: alias graphs, every code point, a file made by hand, edited licenses."""

import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from arbiter.llm import byte_bpe, exact_dedup, license_scan, matroska, ngram_join, packing, toxicity, url_filter


def alias_pages(n, seed=1):
    """Pages with chains of redirects, a hub that a third of all pages name, pairs, and pages without aliases."""
    r = random.Random(seed)
    hosts = ["a.com", "b.net", "example.com", "example.net", "c.org", "d.io"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'fr'])}/{i}" for i in range(n)]
    edges = {}
    for i in range(1, n):
        if i % 3 == 0:
            edges[i] = 0
        elif i % 3 == 1 and i % 100 > 20:
            edges[i] = i + 3 if i + 3 < n else i - 1  # chains of some twenty pages
    link = lambda i: f"<link rel='canonical' href='{urls[edges[i]]}'>" if i % 2 else f'<meta http-equiv="refresh" content="0;url={urls[edges[i]]}">'
    return urls, edges, [(i, u, f"<html><head>{link(i) if i in edges else ''}</head></html>") for i, u in enumerate(urls)]


def test_url_filter_over_a_graph_of_aliases(spark):
    urls, edges, rows = alias_pages(1200)
    home = list(range(len(urls)))

    def find(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for a, b in edges.items():
        home[find(a)] = find(b)

    def own(u):
        host, path = u.removeprefix("http://").split("/", 1)
        fits = [(rule, v) for rule, v in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and f"/{path}".startswith(rule[rule.index("/"):])]
        return max(fits, key=lambda x: len(x[0]))[1] if fits else None

    seen = {}
    for i, u in enumerate(urls):
        seen.setdefault(find(i), set()).add(own(u))
    want = {i: own(u) or ("block" if "block" in seen[find(i)] and "allow" not in seen[find(i)] else "allow") for i, u in enumerate(urls)}
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == want and len(set(want.values())) == 2


def test_byte_bpe_at_every_code_point():
    enc = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.rank, special_tokens={})
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{0}", "a{0}", " {0}", "{0}a", "1{0}.", "{0} {0}"):
        texts = [" b ".join(form.format(c) for c in every[k : k + 4096]) for k in range(0, len(every), 4096)]
        ids, _ = enc.encode(texts)
        for t, x in zip(texts, ids, strict=True):
            assert x.tolist() == own.encode_ordinary(t), (form, hex(ord(t[0])))


def test_matroska_reads_a_file_made_by_hand():
    """Bytes spelled out from the format's definition: header, one audio track, a cluster, a cue to it."""
    track = bytes.fromhex("ae 9a d7 81 01 73 c5 81 01 83 81 02 86 8d") + b"A_PCM/INT/LIT"
    tracks = bytes.fromhex("16 54 ae 6b") + bytes([0x80 | len(track)]) + track
    cluster = bytes.fromhex("1f 43 b6 75 94 e7 81 05 a3 87 81 00 02 80") + b"abc" + bytes.fromhex("a3 86 81 00 04 00") + b"de"
    cues = bytes.fromhex("1c 53 bb 6b 8d bb 8b b3 81 05 b7 86 f7 81 01 f1 81") + bytes([len(tracks)])
    body = tracks + cluster + cues
    data = bytes.fromhex("1a 45 df a3 80 18 53 80 67") + bytes([0x80 | len(body)]) + body
    got = matroska.parse(data)
    assert [(p.track, p.timestamp, data[p.offset : p.offset + p.length], p.keyframe) for p in got.packets] == [(1, 7, b"abc", True), (1, 9, b"de", False)]
    assert got.clusters == [data.index(cluster)] and got.cues == [(5, 1, data.index(cluster))]
    assert matroska.payload(data, got) == b"abcde"
    assert matroska.feature(data, got).startswith("packets=2 clusters=1 cues=1 ")
    x = np.frombuffer(b"abcde", np.uint8)
    assert f"mean={x.mean():.3f} spread={x.std():.3f} turns=0" in matroska.feature(data, got)


def test_media_digests_describe_what_is_stored(spark):
    rows = matroska.media_digests(spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string")).collect()
    for r, text in zip(sorted(rows), ("x" * 500, ""), strict=True):
        stored = matroska.write(matroska.pad(text.encode()))
        x = np.frombuffer(matroska.pad(text.encode()), np.uint8).astype(float)
        assert r["media_bytes"] == len(stored) and f"mean={x.mean():.3f} spread={x.std():.3f}" in r["feature"]
        assert struct.unpack(">I", stored[:4])[0] == 0x1A45DFA3


def test_license_scan_finds_edited_notices(spark):
    """Recall over windows with words changed up to the least containment that counts."""
    r, rows, want = random.Random(4), [], set()
    filler = lambda n: " ".join(r.choice(["amber", "birch", "cedar", "dune"]) + str(r.randrange(50)) for _ in range(n))
    for name, text in license_scan.TEMPLATES.items():
        words = license_scan.template_words(text)
        shingles = set(license_scan.template_shingles(words))
        for k in range(60):
            edited = list(words)
            for _ in range(r.randrange(3)):
                edited[r.choice([r.randrange(len(edited)), 0, len(edited) - 1])] = f"zz{r.randrange(99)}"
            if len(shingles & set(license_scan.template_shingles(edited))) >= license_scan.CONTAINMENT * len(shingles):
                want.add((len(rows), name))
            rows.append((len(rows), f"{filler(r.randrange(80))} {' '.join(edited)} {filler(r.randrange(40))}"))
    got = {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 300 and len(want & got) / len(want) >= 0.99


def test_exact_dedup_with_full_indexes_and_hot_groups(spark, monkeypatch):
    """Indexes that are emptied again and again, and groups that are broadcast, give the same groups."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(600)] + [(None, "hot"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str)
    kept = sorted(map(tuple, exact_dedup.kept_documents(df).collect()), key=str)
    for held, share in ((3, 1000), (10**6, 1), (3, 2)):
        fold = exact_dedup._fold

        def small(ordered, fold=fold, held=held):
            def run(batches):
                exact_dedup.HELD = held
                yield from fold(ordered)(batches)

            return run

        monkeypatch.setattr(exact_dedup, "_fold", small)
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == want
        assert sorted(map(tuple, exact_dedup.kept_documents(df).collect()), key=str) == kept
        monkeypatch.undo()


def test_toxicity_recomputed_by_hand(spark):
    """Counts, ratios, the fit's stationary point and scores, from plain Python."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["river", "stone", "cloud", "meadow"]) for _ in range(12)) + (" vile scum" if i % 3 == 0 else "") for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {x["doc_id"] for x in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    train = [i for i in range(240) if i not in held]

    def places(t):
        low = f" {t.lower()} "
        return {int(p) for p in toxicity.features([t])[1]} if low else set()

    has = [places(t) for t in texts]
    n_pos = sum(i % 3 == 0 for i in train)
    n_neg = len(train) - n_pos
    ratio = {}
    for p in set().union(*(has[i] for i in train)):
        pos = 1 + sum(p in has[i] for i in train if i % 3 == 0)
        neg = 1 + sum(p in has[i] for i in train if i % 3)
        x = np.log(pos / (n_pos + 2)) - np.log(neg / (n_neg + 2))
        if abs(x) / np.sqrt(1 / pos + 1 / neg) >= toxicity.LEAST_Z:
            ratio[p] = x
    assert set(model.place.tolist()) == set(ratio)
    weight = dict(zip(model.place.tolist(), model.weight.tolist(), strict=True))
    by_hand = [1 / (1 + np.exp(-(model.intercept + sum(weight.get(p, 0) for p in h)))) for h in has]
    out = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert np.allclose([out[i] for i in range(240)], by_hand, atol=1e-9)
    # At the fit, the gradient of every coefficient is its ridge's, up to what the steps leave.
    for p, x in list(ratio.items())[:20]:
        slope = sum((by_hand[i] - (i % 3 == 0)) * x for i in train if p in has[i]) + 0.1 * weight[p] / x
        assert abs(slope) < 0.5


def test_toxicity_bound_holds_with_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    seen = []
    logistic = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda *a, **k: seen.append(len(a[3])) or logistic(*a, **k))
    toxicity.fit(docs, labels, max_rows=3)
    assert all(n <= 3 for n in seen)


def test_shingles_beyond_the_plain_prefix_make_no_hubs():
    """Of sets of seven shingles the two rarest make hubs: what all have at a later place joins nothing, and counts as spare."""
    rows = np.zeros(3 * 40, ngram_join.POSTING)
    for k in range(40):
        rows[3 * k : 3 * k + 3] = [(1000 + k, k, 7, 0), (7, k, 7, 1 if k < 10 else 2), (8, k, 7, 4)]

    class Cold:
        value = np.zeros(1 << ngram_join.SKETCH, bool)

    batch = pa.record_batch([pa.array([0]), pa.array([rows.tobytes()])], names=["bucket", "postings"])
    out = [r for b in ngram_join._shared(Cold)(iter([batch])) for r in b.to_pylist()]
    hubs = [r for r in out if r["kind"] == ngram_join.HUB]
    assert sorted(r["y"] for r in hubs) == list(range(10)) and len({r["x"] for r in hubs}) == 1
    assert {r["x"]: r["n"] for r in out if r["kind"] == ngram_join.SPARE} == dict.fromkeys(range(40), 2)
    assert not [r for r in out if r["kind"] == ngram_join.PAIR]


def test_packing_joins_what_lies_in_different_nodes(spark, monkeypatch):
    """Rounds go on while a small bin may find company, however few of the others it fits."""
    monkeypatch.setattr(packing, "NODE", 10)
    length = "CASE id WHEN 7 THEN 1100L WHEN 8 THEN 900L ELSE 1800L END"
    pieces = spark.range(302).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"{length} AS length", "id AS ids_crc32")
    out = packing.pack(pieces).collect()
    place = {r["doc_id"]: r["sequence_id"] for r in out}
    assert len(out) == 302 and len(set(place.values())) == 301 and place[7] == place[8]


def test_packing_passes_on_enough_bins_of_each_length(spark):
    """Of each length as many bins stay as there are small ones, counted over the nodes."""
    rows = [(1100, k // 4, f"a{k}".encode()) for k in range(40)] + [(1500, 0, b"b"), (1600, 0, b"c")] + [(500, 0, b"s"), (450, 0, b"t")]
    bins = spark.createDataFrame(rows, "length long, rank int, members binary")
    leaving, staying = packing._joinable(bins, 2048)
    kept = [r["length"] for r in staying.collect()]
    assert sorted(kept) == [450, 500, *[1100] * 4, 1500]
    assert leaving.count() + len(kept) == len(rows)
    assert packing._joinable(bins.where("length > 1024"), 2048)[1] is None


def test_ranks_within_lengths():
    assert packing._ranks(np.array([5, 3, 5, 5, 3])).tolist() == [0, 0, 1, 2, 1]
    assert packing._ranks(np.zeros(0, np.int64)).tolist() == []
