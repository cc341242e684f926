"""Media, classifier, URL filters, exact top-k, mixing, personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import jpeg, media, pii, quality, textkit
from tidewell.llm import top_k as top
from tidewell.llm.curriculum import in_order, mix
from tidewell.llm.top_k import top_k
from tidewell.llm.url_filters import decide

DOCS = "doc_id long, text string"


# --- media

def test_jpeg_round_trip():
    g = random.Random(1)
    raws = [b"", b"\x80" * 64, b"\x80" * 700, bytes(range(256)), b"\xff" * 1000, b"\x00\x80" * 500] + [bytes(g.choice([0, 127, 128, 128, 128, 129, 255]) for _ in range(g.randint(1, 4000))) for _ in range(60)]
    payloads = [media.payload_of(r) for r in raws]
    for p, (w, h, mark, coefs) in zip(payloads, media._features(jpeg.write(payloads))):
        assert (coefs.reshape(-1)[: len(p)] + 128).astype("uint8").tobytes() == p
        assert w % 8 == 0 and h % 8 == 0 and w * h >= len(p) and len(mark) == 16


def test_long_payloads_are_written_in_parts(monkeypatch):
    g = random.Random(2)
    payloads = [bytes(g.choice([0, 127, 128, 255, 97, 32]) for _ in range(64 * n)) for n in (1, 7, 8, 9, 130, 16, 300)]
    whole = jpeg.write(payloads)
    monkeypatch.setattr(jpeg, "PART", 16)
    assert jpeg.write(payloads) == whole


def test_thumbnail_is_the_mean_grey_of_each_block():
    image = jpeg.parse(jpeg.write([bytes([200]) + b"\x80" * 63 + bytes([40]) + b"\x80" * 63])[0])
    assert jpeg.thumbnail(image, jpeg.read([image])[0]).tolist() == [[200, 40]]


def colour_jpeg():
    """16 x 16, three components sampled 2x2, 1x1, 1x1, without restart markers: DC values only, written bit by bit."""
    bits = ""
    for size, value in ((3, 5), (0, 0), (3, -5), (0, 0), (2, 3), (2, -2)):  # DC differences: four of Y, Cb, Cr
        bits += format(jpeg._DC[size][0], "04b") + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")
        bits += format(jpeg._AC[0][0], f"0{jpeg._AC[0][1]}b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + jpeg._TABLES + jpeg._segment(jpeg.SOF0, frame) + jpeg._segment(jpeg.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_decoder_reads_subsampled_colour_and_refuses_the_rest(spark):
    image = jpeg.parse(colour_jpeg())
    assert jpeg.thumbnail(image, jpeg.read([image])[0]).tolist() == [[133, 133], [128, 128]]
    rows = [(1, colour_jpeg()), (2, None), (3, b"no image"), (4, colour_jpeg()[:-8]), (5, jpeg.write([b"x" * 64])[0]), (6, colour_jpeg().replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {r.media_id: r for r in media.media_features(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert (got[1].width, got[1].height, got[5].width) == (16, 16, 8)
    assert [got[k].thumbnail_hash for k in (2, 3, 4, 6)] == [None] * 4


def test_media_query(spark):
    rows = [(1, None), (2, ""), (3, "x" * 63), (4, "x" * 64), (5, "é" * 100), (6, "long " * 50_000), (6, "long " * 50_000)]
    got = media.text_media(spark.createDataFrame([(*r, "m") for r in rows], DOCS + ", media string")).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.text_media(spark.createDataFrame([], DOCS)).count() == 0
    stored = media.encode_texts(spark.createDataFrame([(1, "abc")], DOCS)).head()
    assert hashlib.sha256(bytes(stored.media)).hexdigest() == media.text_media(spark.createDataFrame([(1, "abc")], DOCS)).head().media_sha256


# --- quality

def test_classifier_learns_and_is_reproducible(spark):
    g = random.Random(2)
    good, bad = ["ver", "lan", "sto", "min"], ["##", "zz9", "qq!", "xx"]
    rows, labels = [], []
    for i in range(400):
        y = int(g.random() < 0.7)
        rows.append((i, " ".join("".join(g.choice(good if y else bad) for _ in range(3)) for _ in range(g.randint(3, 40)))))
        labels.append((i, y))
    rows += [(900, None), (901, "")]
    docs, marked = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", quality int"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = [{r.doc_id: (r.score, r.predicted) for r in quality.score(docs, quality.fit(docs, marked.where("doc_id < 250"), buckets=4096)).collect()} for _ in range(2)]
    assert out[0] == out[1] and out[0][900] == out[0][901]
    assert np.mean([out[0][i][1] == y for i, y in labels if i >= 250]) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in out[0].values())
    none = quality.fit(docs, marked.where("doc_id < 0"), buckets=64)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    held = {r.doc_id for r in docs.where(quality.held_out(docs.doc_id)).collect()}
    assert held == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_training_takes_all_features(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(6000)) + " twice twice"
    docs = spark.createDataFrame([(0, long), (1, "short one"), (2, long + " x")], DOCS)
    marked = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality.Model, "train", lambda self, rows, labels, *more: got.extend(zip(rows, labels)))
    quality.fit(docs, marked)
    assert [int(y) for _, y in got] == [1, 0, 0]
    for ((at, share), _), text in zip(got, (long, "short one", long + " x")):
        bucket = np.concatenate([b for _, b in quality.Features(1 << 18).rows([text])])
        want, n = np.unique(bucket, return_counts=True)
        assert np.array_equal(at, want) and np.allclose(share, n / n.sum())
    assert len(got[0][0][0]) > 9000


def test_features_do_not_depend_on_windows(monkeypatch):
    rows = ["ab abc abcd ab ab", None, "", "x" * 300 + " y y", "zz " * 200, "É é"]
    def counted():  # noqa: E306
        got = [[] for _ in rows]
        for place, bucket in quality.Features(1 << 12).rows(rows):
            for i, b in zip(place.tolist(), bucket.tolist()):
                got[i].append(b)
        return [sorted(x) for x in got]
    whole = counted()
    assert whole[1] == whole[2] == [] and len(whole[0]) == (3 + 1) + 5 + 4 + 3 + 2  # grams, words, pairs up to three apart
    monkeypatch.setattr(quality, "windows", lambda data: textkit.windows(data, 16))
    assert counted() == whole


def test_one_step_of_training_is_the_gradient_s():
    model = quality.Model(8, 3, 1)
    table, layer = model.table.astype(float), np.random.default_rng(2).normal(size=(3, 2))
    model.layer[:] = layer
    at, share, y = np.array([1, 5]), np.array([0.25, 0.75], dtype=np.float32), 1

    def loss(t, w, b):
        z = (share[:, None] * t[at]).sum(axis=0) @ w + b
        return 0.5 * -np.log(np.exp(z[y]) / np.exp(z).sum())  # one label only: half the weight

    def slope(which, place, e=1e-6):
        args = [table.copy(), layer.copy(), np.zeros(2)]
        args[which][place] += e
        return (loss(*args) - loss(table, layer, np.zeros(2))) / e

    model.train([(at, share)], np.array([y]), epochs=1, rate=0.1, seed=0)
    for i in np.ndindex(8, 3):
        assert np.isclose(model.table[i], table[i] - 0.1 * slope(0, i), atol=1e-4)
    for i in np.ndindex(3, 2):
        assert np.isclose(model.layer[i], layer[i] - 0.1 * slope(1, i), atol=1e-4)
    apart, bias = model.weights()
    want = (share[:, None] * model.table[at]).sum(axis=0) @ (model.layer[:, 1] - model.layer[:, 0]) + model.bias[1] - model.bias[0]
    assert np.isclose((apart[at] * share).sum() + bias, want, atol=1e-5)


def test_scores_are_the_mean_of_all_features(spark):
    weights, bias = np.random.default_rng(3).normal(size=512).astype(np.float32), 0.25
    texts = [(1, "one two two three"), (1, "one two two three"), (2, None), (3, ""), (4, "word " * 40_000 + "end"), (5, "é" * 900_000)]
    got = quality.score(spark.createDataFrame([(*r, 9.0) for r in texts], DOCS + ", score double"), (weights, bias)).collect()
    assert len(got) == len(texts)
    for r in got:
        held = np.concatenate([b for _, b in quality.Features(512).rows([dict(texts)[r.doc_id]])])
        z = (weights[held].astype(float).mean() if len(held) else 0.0) + bias
        assert np.isclose(r.score, 1 / (1 + np.exp(-z))) and r.predicted == (r.score >= 0.5)
    assert quality.score(spark.createDataFrame([], DOCS), (weights, bias)).count() == 0


# --- URL filters

def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    urls = {1: "http://A.Example.COM/en/x?q", 2: "https://www.example.com/en/", 3: "http://spam.net/es", 4: "http://x.spam.net/fr/#a", 5: None, 6: "no scheme", 7: "http://", 8: "http://ok.org?u=http://spam.net/es/", 9: "http://com/", 10: "http://xcom/", 11: "http://a.net/es/://b", 12: "http://a.net/es/://b"}
    pages = spark.createDataFrame([(*r, "z") for r in urls.items()], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in decide(pages, rules, spark.createDataFrame([("spam.net",), ("unseen.org",)], "host string")).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("spam.net", "/es", None, "block"),
        4: ("x.spam.net", "/fr/", None, "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("ok.org", "", None, "allow"),
        9: ("com", "/", "com/", "allow"), 10: ("xcom", "/", None, "allow"), 11: ("a.net", "/es/://b", "net/es/", "block"), 12: ("a.net", "/es/://b", "net/es/", "block"),
    }
    empty = spark.createDataFrame([], "page_id long, url string")
    assert decide(empty, rules, spark.createDataFrame([], "host string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    from tidewell.llm.url_filters import Cascade

    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    known = Cascade(keys.where("listed").select("key"), keys.select("key"))
    assert len(known.levels) > 1
    assert known.attach(keys).where(known.contains(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("bound", [0, 60])
def test_levels_beyond_the_broadcast_bound_stay_exact(spark, monkeypatch, bound):
    from pyspark.sql import functions as F

    from tidewell.llm import url_filters

    for name in ("MAX_LISTED", "BROADCAST_KEYS"):
        monkeypatch.setattr(url_filters, name, bound, raising=False)
    keys = spark.range(40000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    known = url_filters.Cascade(keys.where("listed").select("key"), keys.select("key"))
    assert len(known.levels) > 2 and 0 in known.blocks and known.blocks[0] > 1
    assert (len(known.blocks) < len(known.levels)) == (bound > 0)
    assert {r.key for r in known.members(keys.select("key")).collect()} == {r.key for r in keys.where("listed").collect()}

    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    blocked = [f"h{i}.net" for i in range(0, 300, 3)] + ["h1.com", "unseen.org"]
    urls = [f"http://{s}h{i}.{top}{path}" for i in range(300) for s in ("", "a.") for top, path in (("net", "/es/x"), ("net", "/fr"), ("com", ""))] + ["http://www.example.com/en/1", "http://b.example.com/en/1", None, "x", "http://", "http://h3.net/fr", "http://h3.net/fr"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in decide(pages, rules, spark.createDataFrame([(h,) for h in blocked], "host string")).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, slash, path = (url or "").partition("://")[2].partition("/")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        want = max(fits)[1:] if fits else (None, "block" if any(host == b or host.endswith("." + b) for b in blocked) else "allow")
        assert got[i] == want, url


# --- exact top-k

@pytest.mark.parametrize("k", [1, 5, 300])
def test_top_k(spark, k):
    g = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in g.normal(size=7).round(1)]) for i in range(220)]
    rows += [(1000, None), (1050, [float("nan")] * 7), (1100, [1.0, None, *[1.0] * 5]), (1150, [float("inf")] * 7), (1200, [1.0, 2.0]), (1250, [])]
    got = [tuple(r) for r in top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int"), every=50, k=k, lists=3).orderBy("query_id", "rank").collect()]
    vec = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v in rows[:220]}
    want = []
    for q in (0, 50, 100, 150, 200):
        order = sorted(((-int(vec[q] @ vec[i]), i) for i in vec if i != q))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert got == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_any_numbers_widths_and_repeats(spark, monkeypatch):
    g = np.random.default_rng(7)
    draw = lambda n, scale: [float(x) for x in g.normal(size=n) * scale]
    rows = [(i, draw(3, 1.0)) for i in range(90)] + [(100 + i, draw(2, 10.0**g.integers(-2, 8))) for i in range(60)]
    rows += [(0, [0.5, 0.25, 1.0]), (0, [0.5, 0.25, 1.0]), (50, [1.0, 1.0]), (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0])]
    rows += [(500, [1e7, 1.0]), (501, [1e7, 0.0]), (550, [1e300, -1e300]), (551, [1e300, 1e300]), (600, [0.0]), (601, [-3.0]), (650, [0.0, 0.0]), (700, [1.0] * 5)]
    for name, value in (("ROWS_A_BLOCK", 16), ("QUERIES_A_BLOCK", 2), ("PROBED", 3)):
        monkeypatch.setattr(top, name, value)
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=4).collect())
    vec = [[int(np.floor(256 * x)) for x in v] for _, v in rows]
    want = []
    for q, (name, v) in enumerate(rows):
        if name % 50 == 0:
            held = [(-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(vec[q], vec[i])))), rows[i][0]) for i in range(len(rows)) if i != q and len(vec[i]) == len(v)]
            want += [(name, n + 1, i, -s) for n, (s, i) in enumerate(sorted(held)[:4])]
    assert got == sorted(want)
    assert any(r[0] == 500 and r[3] >= 6553600000000000000 for r in got)


# --- mixing

def test_mix_is_in_the_order_of_training(spark):
    df = spark.createDataFrame([(k, "a b " * (k % 7), f"s{k % 3}" if k % 5 else None) for k in range(300)], "doc_id long, text string, source string").repartition(5)
    rows = mix(df).collect()
    keys = [(r.position is None, r.position or 0.0, r.doc_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == 300
    assert len({r.source for r in rows[:60]}) == 4 and any(k[0] for k in keys)  # sources alternate; empty texts come last


def test_mix(spark):
    g = random.Random(5)
    rows = [(i, "w " * g.randint(0, 60), g.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(1000, None, "a"), (1001, "", None), (1002, "w " * 9000, "e")]
    df = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", source string, target string")
    got = {r.doc_id: r for r in mix(df).collect()}
    again = {r.doc_id: r for r in mix(df).collect()}
    assert got == again and len(got) == len(rows)
    sizes, source = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in {*source.values()}}
    target, left, open_ = {}, 1.5 * sum(total.values()), dict(zip(sorted(total, key=lambda s: (s is None, s)), (5, 2, 1, 5, 2, 1)))
    while open_:  # the plain way: share, cap those above, share again
        level = left / sum(open_.values())
        above = [s for s, w in open_.items() if level * w > 2 * total[s]]
        for s in above or list(open_):
            target[s] = 2 * total[s] if above else level * open_[s]
            left -= target[s] if above else 0
            del open_[s]
    for s in total:
        mine = [got[i] for i in sizes if source[i] == s]
        assert all(r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    for i, r in got.items():
        assert r["size"] == sizes[i] and 0 <= r.taken <= 2 * sizes[i]
        assert (r.position is not None) == (r.taken > 0) and (r.position_again is None or r.position <= r.position_again <= 1)
    for s in total:  # places on the source's stream: one after the other, and read when the integrated schedule is due
        tilt = (-0.5, 0.0, 0.5)[sorted(total, key=lambda x: (x is None, x)).index(s) % 3]
        mine = sorted((got[i] for i in sizes if source[i] == s and got[i].position is not None), key=lambda r: (r.position, r["size"] > 0))
        at = 0
        for r in mine:
            share = at / target[s]
            assert abs((1 - tilt) * r.position + tilt * r.position**2 - share) < 1e-9
            at += r["size"]
    copies = in_order(df.withColumnRenamed("target", "_time"))
    assert copies.columns == ["doc_id", "text", "source", "_time"]
    assert copies.count() == sum((r.position is not None) + (r.position_again is not None) for r in got.values())
    assert mix(spark.createDataFrame([], DOCS + ", source string")).count() == 0


# --- personal data

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_base_spans(spark):
    g = random.Random(8)
    texts = ["a@b.c_d@e.f g@h.i@j.k", "1.2.3.4.5 0255.1.1.1 256.1.1.1 00000000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111- 4111111111111111 4111  11111111 1111", "+1 (234) 555-6789. +12 +1...........2 +123456789 ", "é🎉 x@y.zz 4111 1111 1111 1111", "4111111111111111", None, "", "1 2 3 4 5 6 7 8 9 0 " * 2000, "5" * 9000, "a." * 9000, "%" * 9000 + "@a.b"]
    texts += ["".join(g.choice("0123456789 -.+@a(") for _ in range(300)) for _ in range(150)]
    got = pii.find_personal(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", base int"), support=10**6).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_spans(texts[r.doc_id])
        assert r.spans == want, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k, _ in FORMS)
    assert pii.find_personal(spark.createDataFrame([], DOCS)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"well you can reach me at phone +1 234 555 10{i:02d} ok") for i in range(12)]
    rows += [(100, "hello reach at Phone 5550109988 ok"), (101, "order number 123456789 ok"), (102, "at phone nothing"), (103, "at phone 555-010-9977.")]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    assert [[x.value for x in got[i].added] for i in (100, 101, 102, 103)] == [["5550109988"], [], [], ["555-010-9977"]]
    assert got[100].spans == "phone:21:31" and got[0].spans.startswith("phone:") and (got[100].n_spans, got[100].n_added, got[100].n_phone) == (1, 1, 0)


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+|(?<=[=:])(?=[^\x20\x09-\x0D=:/])", text.lower()) if w]


def brute_discovery(texts, mentions, support=4, confidence=0.75, rounds=3):
    """Kinds of (text, value) from ``mentions`` of (text's place, text before, value, kind of the seed or None)."""
    of = []
    for i, before, v, k in mentions:
        w = split_words(before)
        if w and re.fullmatch("[\"'(\\[]+", w[-1]):
            w = w[:-1]
        of.append((i, [(w[-1],), *([(w[-2], w[-1])] if len(w) > 1 else [])], v, k))
    edges = {(p, v): k for _, ps, v, k in of for p in ps}
    uses, places = {}, {}
    for t in texts:
        w = split_words(t)
        for n in range(1, len(w)):
            for p in ((w[n - 1],), *([(w[n - 2], w[n - 1])] if n > 1 else [])):
                uses[p] = uses.get(p, 0) + 1
    for p in {p for p, _ in edges}:
        n = len({v for q, v in edges if q == p})
        if n >= support:
            places[p] = n + max(0, uses.get(p, 0) - sum(p in ps for _, ps, _, _ in of))
    edges = {(p, v): k for (p, v), k in edges.items() if p in places}
    score = {v: 0.0 for _, v in edges} | {v: 1.0 for (_, v), k in edges.items() if k is not None}
    kind = {v: k for (_, v), k in edges.items() if k is not None}
    for _ in range(rounds):
        sure = {}
        for p, n in places.items():
            mine = [v for q, v in edges if q == p]
            votes = [kind[v] for v in mine if v in kind]
            if sum(score[v] for v in mine) / n >= confidence:
                sure[p] = sum(score[v] for v in mine) / n, max(sorted({*votes}), key=votes.count)
        for v in score:
            best = max(((b, -k) for p, (b, k) in sure.items() if (p, v) in edges), default=(0, 0))
            if best[0] > score[v]:
                score[v], kind[v] = best[0], -best[1]
    out = {}
    for i, ps, v, k in of:
        best = max(((sure[p][0], -sure[p][1]) for p in ps if p in sure), default=None)
        if best and k in (None, 4):
            out[i] = [(v, -best[1])]
    return out


def test_graph_scores_match_brute_force(spark):
    keys = ["%040x" % random.Random(i).getrandbits(160) for i in range(12)]
    near = ["555 010 9988", "AB12345", "(555) 010-7766", "555.010.6655"]
    said = [("my phone", f"+1 234 555 10{i:02d}", 3) for i in range(24)] + [("my phone", v, None) for v in near]
    said += [("his line", v, None) for v in near] + [("his line", "777 888 9999", None)]  # no seed stands there
    said += [("order number", v, None) for v in ("11 2222", "33 4444", "55 6666", "77 8888")]
    said += [('it has token = "', k, 4) for k in keys[:6]] + [('token="', "Zx81-4402-77", None), ("x Token = ", "9081726354", None)]
    said += [("commit", k, 4) for k in keys[6:]]  # followed by other things more often than not
    said += [("the", f"a{i}@b.example", 0) for i in range(5)] + [("the", "1234567890", None)]
    said += [("secret:", k, 4) for k in keys[:3]] + [("secret:", "998877665544", None), ("key: '", "abc-123456", None)]
    docs, mentions = [], []
    for i, (before, v, k) in enumerate(said):
        head = f"w{i} {before}" + ("" if before[-1] in "\"'(=" else " ")
        text = f"{head}{v} ok"
        if v.startswith("("):
            head, v = head + "(", v[1:]
        docs.append(text)
        mentions.append((i, head, v, k))
    docs += ["the commit was the one", "commit to the order", "commit it", "a token of the day", "my way", "his way"] * 2
    want = brute_discovery(docs, mentions)
    got = {r.doc_id: [(x.value, x.kind) for x in r.added] for r in pii.find_personal(spark.createDataFrame(list(enumerate(docs)), DOCS)).collect()}
    assert {i: x for i, x in got.items() if x} == want
    kinds = {said[i][0]: k for i, [(_, k)] in want.items()}
    assert kinds["his line"] == 3 and kinds['it has token = "'] == 4 and "commit" not in kinds and "the" not in kinds and "order number" not in kinds


def test_personal_data_in_long_and_repeated_texts(spark):
    key = "0123456789abcdef" * 3
    rows = [(i, f"x token = {'%040x' % (i + 10 * 16**39)} y") for i in range(6)]
    rows += [(50, "a" * 500 + f" token = {key} " + "b " * 5000 + f"token = {key}"), (51, "a" * 500 + f" {key}"), (5, rows[5][1]), (60, None), (61, ""), (62, "\n")]
    got = pii.find_personal(spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", spans string")).collect()
    n = {r.doc_id: r.n_added for r in got}
    assert len(got) == len(rows) and n[50] == 2 and n[51] == 0 and sum(r.n_added for r in got if r.doc_id == 5) == 2
    assert [(r.spans, r.n_spans) for r in got if r.doc_id >= 60] == [("", 0)] * 3
