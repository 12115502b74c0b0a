"""Each operator against plain Python or SQL, on small and awkward tables."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import bpe, boosting, induced, langid, license_scan, mixing, pages, repetition, simhash, spotsigs, suffix_dedup, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "", "a"), (2, None, "b"), (None, "no id here", None), (3, "the cat sat on the mat " * 30, "a"), (3, "the cat sat on the mat " * 30, "a"), (4, "é" * 900, "b"), (5, "x\n\ny\nx\n", "a"), (6, "\x00\x01 ### <|endoftext|>", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("size", F.lit(-1)).withColumn("n_chars", F.lit(0).cast("long"))


def local(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def empty(frame):
    return frame.where("1 = 0")


def test_repetition(docs, odd):
    for frame in (docs, odd):
        want = []
        for i, t in local(frame):
            w = WORD.findall(t)
            c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            cover = {x for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want.append((i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
        got = [tuple(r)[:7] for r in repetition.repetition_rules(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert repetition.repetition_rules(empty(docs)).count() == 0


def test_longest_repeats():
    rng = random.Random(3)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(3)]
        want = []
        for w in texts:
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    k = 0
                    while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        flat = np.array([x for w in texts for x in w], np.int64)
        assert repetition.longest_repeats(flat, np.repeat(np.arange(3), [len(w) for w in texts])).tolist() == want


def test_main_text(spark):
    forest = pages.model()
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">menu item</a></li></ul></nav><div class="ad">buy this now</div><article><h1>A &amp; B title</h1><p><b>One  two\nthree four five.<br><p>Six seven &lt;eight&gt; nine ten eleven twelve.</p><form><p>subscribe here</p></form></article><section class="comments"><div class="comment"><p>first reader says hi</p></div></section><footer>&copy; us'
    assert pages.extract([page], forest) == ["A & B title\nOne two three four five.\nSix seven <eight> nine ten eleven twelve."]
    frame = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p"), (3, "u", page), (3, "u", page)], "page_id long, url string, html string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(frame).collect()}
    assert (1, "", 0) in got and (None, "", 0) in got and len([g for g in got if g[0] == 3]) == 1
    assert pages.main_text(frame).count() == 5 and pages.main_text(empty(frame)).count() == 0


def test_main_text_without_body():
    """Text outside of all blocks, alone, before, between and after them."""
    forest = pages.model()
    long = "This is a plain page with a few words in it, more than a line of them, and nothing else at all."
    assert pages.extract([long, "<b>Hello</b> world", f"{long}<p>{long}</p>{long}", f"<html><body><p>{long}</p></body></html>{long}", "\ufeff"], forest) == [long, "Hello world", f"{long}\n{long}\n{long}", f"{long}\n{long}", ""]
    assert pages.extract([f"{long}<html><body><article><p>{long}</p></article></body></html>"], forest) == [f"{long}\n{long}"]


def test_main_text_after_unclosed_elements():
    forest = pages.model()
    one, two = "The first words of the story stand here and go on a while.", "And the second part of it stands here, below the first one."
    page = "<html><body><article><h1>A title of it</h1><p>{}</p>{}<p>{}</p></article></body></html>"
    for inner in ("<button>", "<select>", "<template>", "<noscript>", "<svg>", '<svg width="1"/>', "<svg/>", "<button/>"):
        assert pages.extract([page.format(one, inner, two)], forest) == [f"A title of it\n{one}\n{two}"], inner
        name = inner.strip("</>").split()[0]
        assert pages.extract([page.format(one, inner, f"{two}<{name}>gone</{name}>")], forest) == [f"A title of it\n{one}\n{two}"], inner
    for inner in ("<svg><svg>x</svg>gone</svg>", "<svg><!-- <svg> --><svg/>gone</svg>", "<svg width=1/>gone</svg>", "<template><template>x</template>gone</template>", "<button>gone</button>"):
        assert pages.extract([page.format(one, inner, two)], forest) == [f"A title of it\n{one}\n{two}"], inner


def test_main_text_on_new_pages():
    """Pages that the trees were not trained on."""
    forest, draw, right, total = pages.model(), pages._Draw(991), 0, 0
    for _ in range(60):
        source, labels = draw.page()
        page = pages.Page(source)
        if len(page.tag) == len(labels):
            right += int(((forest.margin(page.features()) > 0) == np.array(labels)).sum())
            total += len(labels)
    assert right / total > 0.98


def test_boosting():
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert (((boosting.fit(x, y).margin(x) > 0) == y).mean()) > 0.97


def test_bpe(docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe._file(None)
    lib = tokenizers.Tokenizer.from_file(path)
    more = ["ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ", "we'll can't", "a" * 3000, "12345 日本語 👩‍👩‍👧", "a\u0085b\x1cc", "<|startoftext|>x<|endoftext|>", "՘x"]
    tok = bpe.load(path)
    rng = random.Random(2)
    more += [" ".join("".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 18))) for _ in range(400))]
    for t, (ids, spoken) in zip(more, tok.encode_decode(more)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and spoken.decode() == lib.decode(want, skip_special_tokens=False)
    for frame in (docs, odd):
        want = []
        for i, t in local(frame):
            ids = lib.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.encode_digests(frame).collect())
    assert bpe.encode_digests(empty(docs)).count() == 0


def test_warc(spark):
    base = spark.read.parquet(f"{DATA}/pages.parquet").limit(20)
    frame = base.union(base.selectExpr("page_id + 100000", "url", "html")).union(spark.createDataFrame([(900001, None, None), (900002, "http://x/", "tiny\r\n\r\nWARC/1.1\r\n")], base.schema))
    got = warc.roundtrip(frame).toPandas().sort_values("page_id").reset_index(drop=True)
    c = duckdb.connect()
    c.register("pages", frame.toPandas())
    want = c.sql(warc.ORACLE_SQL).df().sort_values("page_id").reset_index(drop=True)
    for k in want.columns:
        assert ((got[k] == want[k]) | (got[k].isna() & want[k].isna())).all(), k
    assert (got.record_type == "revisit").sum() > 0 and warc.roundtrip(empty(frame)).count() == 0


def test_warc_rows(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a/x", "<p>é</p>")], "page_id long, url string, html string")
    warc.write_captures(frame, str(tmp_path / "w"))
    row = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).first()
    assert row["response"]["payload"].decode() == "<p>é</p>" and row["requests"][0]["fields"][0]["value"] == "a" and row["metadata"][0]["concurrent_to"] == row["capture_id"]


def test_induced_sort():
    rng = random.Random(5)
    for n in range(1, 120):
        t = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(n)]
        t = t + t[n // 3 :] + [0]
        for memory in (1 << 20, 8):
            pos, lcp = (np.concatenate(x).tolist() for x in zip(*induced.sort(np.array(t), 7, 50, memory)))
            assert sorted(pos) == list(range(len(t)))
            for a, b, shared in zip(pos, pos[1:], lcp[1:]):
                k = 0
                while k < 50 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                    k += 1
                assert shared == k and t[a : a + 50] >= t[b : b + 50]


def removal(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        yield len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, k in zip(t, cover) if not k)).hexdigest()


def without_passages(texts, length, words):
    """The texts without the runs of repeated bytes that hold words words or twice length bytes."""
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out, end = b"", 0
        for m in re.finditer(b"\1+", bytes(cover)):
            if len(m[0]) >= 2 * length or len(t[m.start() : m.end()].split()) >= words:
                out, end = out + t[end : m.start()], m.end()
        yield (out + t[end:]).decode("utf-8", "ignore")


def test_suffix_dedup(spark, docs, odd):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd efgh") for _ in range(700))
    made = [(i, "".join(rng.choice("xyz uvw") for _ in range(300)) + passage[i % 7 * 20 :] + "".join(rng.choice("klm nop") for _ in range(500))) for i in range(30)] + [(99, "ab" * 600), (100, passage)]
    mixed = spark.createDataFrame(made, "doc_id long, text string")
    for frame in (docs, odd, mixed):
        rows = local(frame)
        want = [(i, *x) for (i, _), x in zip(rows, removal([t.encode() for _, t in rows], 400))]
        got = [tuple(r) for r in suffix_dedup.removal_report(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.removal_report(empty(docs)).count() == 0
    assert suffix_dedup.without_repeats(odd).columns == odd.columns


def test_hot_lines_are_dealt_by_core(spark, docs):
    """Minimizers of many kinds, all of them hot or some, give what plain counting gives; their extents lie in many parts."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, left, right = word(90), word(330), word(330)
    made = []
    for i in range(300):
        x, y = rng.choice([0, 5, 150, 250, 330]), rng.choice([0, 60, 150, 250, 330])
        made.append((i, word(200) + left[330 - x :] + line + right[:y] + word(200)))
    lines = spark.createDataFrame(made, "doc_id long, text string")
    for frame in (lines, docs):
        rows = local(frame)
        want = [(i, *x) for (i, _), x in zip(rows, removal([t.encode() for _, t in rows], 400))]
        for hot in (16, 64):
            got = [tuple(r) for r in suffix_dedup.removal_report(frame, hot=hot).collect()]
            assert sorted(got) == sorted(want)
    parts = Counter(core for _ in made for core, _, _ in suffix_dedup.by_core(336, (word(336) + line[:64] + word(336)).encode(), 400))
    assert len(parts) == 8 * len(made)


def test_copies_are_dealt_out(spark):
    """A third of the rows is one text, a third is empty or null: rows stay whole and are spread over tasks."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy = word(900)
    made = [(i, copy if i % 3 == 0 else ["", None][i % 2] if i % 3 == 1 else word(600) + (copy[200:650] if i % 2 else "")) for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(12)
    rows = local(frame)
    want = [(i, *x) for (i, _), x in zip(rows, removal([t.encode() for _, t in rows], 400))]
    for hot in (16, 1000):
        assert sorted(tuple(r) for r in suffix_dedup.removal_report(frame, hot=hot).collect()) == sorted(want)
    found = frame.where("length(text) >= 400").select(*suffix_dedup._text_key(F.col("text")), F.lit(0).alias("first"))
    copied = suffix_dedup._copied(found, 16)
    assert [r["ways"] for r in copied.collect()] == [13]
    key = copied.select("t1", "t2", F.lit(1).alias("fact"))
    keyed = frame.na.fill("").select(*suffix_dedup._text_key(F.col("text")), "text", F.spark_partition_id().alias("was"))
    met = suffix_dedup._meet(keyed, key, copied, 400, "left")
    assert met.count() == 600 and met.where("fact = 1").count() == 200


def test_suffix_sorts_are_bounded(monkeypatch):
    """A hot minimizer's cores are sorted in parts, a hot core is cut finer; hits are those of plain counting."""
    rng = random.Random(12)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    line, left, right = word(64), word(336), word(336)
    made = set()
    while len(made) < 120:
        x, y = rng.choice([0, 5, 100, 300, 336]), rng.choice([0, 7, 60, 300, 336])
        made.add(word(336 - x) + left[336 - x :] + line + right[:y] + word(336 - y))
    rows = [(1, 336, body) for body in sorted(made)]
    count = Counter(body[i : i + 400] for _, _, body in rows for i in range(len(body) - 399))
    want = [[i for i in range(len(body) - 399) if count[body[i : i + 400]] > 1] for _, _, body in rows]
    sizes, sort = [], suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda bodies, *a: sizes.append(sum(map(len, bodies))) or sort(bodies, *a))
    for room in (4 << 20, 6000, 2000, 500):
        sizes.clear()
        assert [x.tolist() for x in suffix_dedup.judge(rows, 400, room=room)] == want
        assert max(sizes, default=0) <= room
    assert sum(map(len, want)) > 1000


def test_simhash(docs, odd):
    for frame in (docs, odd):
        rows = local(frame)
        fps = [simhash.fingerprint(t.encode()) for _, t in rows]
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[find(a)] = find(b)
        groups = {}
        for k in range(len(rows)):
            groups.setdefault(find(k), []).append(rows[k][0])
        least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
        want = [(rows[k][0], f"{fps[k]:016x}", least[find(k)]) for k in range(len(rows))]
        got = [tuple(r) for r in simhash.simhash_components(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.simhash_components(empty(docs)).count() == 0


def test_simhash_links_are_whole(spark):
    """Fingerprints at every small distance from one another, all pairs against the grid."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 3, 4, 5) for _ in range(4)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                assert roots[a] == roots[b]


def test_mixing(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    weight = mixing.quality_weight(labels).withColumnRenamed("doc_id", "l")
    got = mixing.mix(docs.join(weight, F.col("doc_id") == F.col("l"), "left").drop("l"), F.col("quality_weight")).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    for k in want.columns:
        assert (got[k] == want[k]).all(), k
    thin = mixing.mix(docs, by_id=mixing.quality_weight(labels), carry=["doc_id"]).select(*want.columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (thin == got[list(want.columns)]).all().all()
    out = mixing.mix(odd)
    assert out.count() == len(ODD) and "in_0" not in out.columns and mixing.mix(empty(docs)).count() == 0


def test_spotsigs(docs, odd):
    for frame in (docs, odd):
        got = spotsigs.fingerprint_report(frame).collect()
        rows = sorted(((-1 << 63 if i is None else i), i, t) for i, t in local(frame))
        want = []
        for k, (_, i, t) in enumerate(rows):
            other, cut = rows[(k + 1) % len(rows)][2], len(t) // 4
            want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + other[:cut]).encode()).hexdigest()))
        assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got) == sorted(map(str, want))
        sets = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
        for r in got:
            a, b = sets(r["fingerprint"]), sets(r["edited_fingerprint"])
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert spotsigs.fingerprint_report(empty(docs)).count() == 0


def test_licenses(spark, docs, odd):
    texts = [(1, "Copyright (c) 2001 Somebody\n" + license_scan.LICENSES["MIT"].upper().replace(",", " ,")), (2, license_scan.LICENSES["BSD-3-Clause"].replace("license", "licence")), (3, "released under the mit licence"), (4, "prose"), (5, None)]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "MIT-notice", 4: None, 5: None}
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = c.sql(license_scan.oracle_sql()).df()
    assert sorted(want.license_digest) == sorted(r["license_digest"] for r in license_scan.scan(docs).collect())
    assert license_scan.scan(odd).count() == len(ODD)


def test_full_licenses(spark):
    """Whole texts of long licences, with and without their appendix, in other case and indentation."""
    full = ["Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    rows = [(k, "\n".join(" * " + x.strip().upper() for x in license_scan.LICENSES[k].split("\n"))) for k in full]
    rows += [(f"{k}-body", license_scan.LICENSES[k].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n") for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1")]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {i: k for i, (k, _) in enumerate(rows)}
    c = duckdb.connect()
    c.register("documents", spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").toPandas())
    want = {(r.doc_id, r.license_digest, r.license_id) for r in c.sql(license_scan.oracle_sql()).df().itertuples()}
    assert want == {tuple(r) for r in got}


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = got.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 200 and right / total > 0.97
    told = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert told[1] == told[2] == "und"
    assert langid.identify(empty(docs)).count() == 0 and langid.accepted(odd).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = p.language(spark, docs, DATA)
    assert one.columns == docs.columns and one.count() == langid.identify(docs).where("lang_pred <> 'und' and score >= 0.1").count()
    two = p.near_duplicates(spark, one, DATA)
    assert sorted(r[0] for r in two.select("doc_id").collect()) == sorted(r[0] for r in simhash.simhash_components(one).select("component_id").distinct().collect())
    three = p.repeated_passages(spark, two, DATA)
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    kept = dict(zip([i for i, _ in rows], without_passages([t.encode() for _, t in rows], p.PASSAGE_BYTES, p.PASSAGE_WORDS)))
    assert three.columns == docs.columns and {r["doc_id"]: r["text"] for r in three.collect()} == kept
    assert p.run(spark, DATA).count() == p.mixture(spark, three, DATA).count() > 0


def test_every_language_is_learned(spark):
    """More languages than a word has bits, and one with a single document to learn from."""
    rng = random.Random(9)
    rows, n = [], 0
    out = {n for (n,) in spark.range(2000).where(langid.held_out(F.col("id"))).collect()}
    for lang in range(130):
        words = ["".join(chr(0x4E00 + 40 * lang + rng.randrange(40)) for _ in range(3)) for _ in range(12)]
        for _ in range(12 if lang < 129 else 1):
            while lang == 129 and n in out:
                n += 1
            rows.append((n, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:03}"))
            n += 1
    text = next(t for _, t, k in rows if k == "l129")
    rows.append((next(x for x in range(n, 2000) if x in out), text, "l129"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, slots=1 << 18)
    assert len(model.languages) == 130 and model.table.shape == (3, 1 << 18)
    told = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert all(told[i] == k for i, _, k in rows)


def test_most_common_ngrams(spark):
    rows = [(at, 65536 * g, 1 + (g * 7 + at) % 40) for at, many in enumerate((4000, 90, 1)) for g in range(many)]
    got = {}
    for r in langid._most_common(spark.createDataFrame(rows, "at int, gram long, n long"), 1000).collect():
        got.setdefault(r["at"], set()).add(r["gram"])
    assert {at: len(g) for at, g in got.items() if at} == {1: 90, 2: 1}
    assert abs(len(got[0]) - 1000) < 60  # those of the last count are drawn by hash
    count = {g: n for at, g, n in rows if at == 0}
    least = min(count[g] for g in got[0])
    assert all(g in got[0] for g, n in count.items() if n > least)
    assert langid._most_common(spark.createDataFrame([], "at int, gram long, n long"), 10).count() == 0


def test_near_duplicates_keep_every_component(spark):
    """Null and shared ids: each component keeps exactly one row."""
    import corpus_pipeline as p

    rng = random.Random(6)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(5))
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (None, d), (9, d), (5, e), (5, e)]
    frame = spark.createDataFrame([(*r, {"k": "v"}) for r in rows], "doc_id long, text string, more map<string,string>")
    got = p.near_duplicates(spark, frame, DATA)
    assert got.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.where("doc_id is not null").collect()) == sorted([(3, a), (7, b), (9, d), (5, e)])
    assert [r["text"] for r in got.where("doc_id is null").collect()] == [c]


def test_nothing_else_imports_this():
    root = Path(__file__).resolve().parents[2] / "claimlens"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and re.search(r"(from|import) [\w.]*\bllm\b", f.read_text())]


def planted(n, words, seed=1):
    """n pairs of documents that share a passage of words words, each in words of its own, and n clean documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    out, passages = [], []
    for _ in range(n):
        passages.append(prose(words))
        out += [f"{prose(80)} {passages[-1]} {prose(70)}" for _ in range(2)]
    return out, passages, [prose(200) for _ in range(n)]


def test_passages_of_many_words_go(spark):
    """What stands twice and has over 50 words goes whole, what has fewer and clean documents stay."""
    import corpus_pipeline as p

    long, passages, clean = planted(40, 51)
    short, fewer, _ = planted(40, 40, 2)
    rows = [(i, t, {"k": i}) for i, t in enumerate([*long, *short, *clean])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>").withColumn("source", F.lit(None).cast("string"))
    got = {r["doc_id"]: r["text"] for r in p.repeated_passages(spark, docs, DATA).collect()}
    assert not [1 for i in range(80) if passages[i // 2] in got[i] or len(got[i].split()) > 152]
    assert all(got[i] == t for i, t in enumerate([*long, *short, *clean]) if i >= 80) and len(fewer) == 40


def test_pipeline_stages_on_odd_tables(spark, odd):
    """Clashing and dotted names, maps, nulls and repeated rows: every stage runs, and only what it decides goes."""
    import corpus_pipeline as p

    more = odd.withColumn("a.b", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("row", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("in_0", F.lit(3))
    for name, stage in p.STAGES[:-1]:
        for frame in (more, empty(more)):
            out = stage(spark, frame, DATA)
            rows = out.collect()
            assert out.columns == more.columns and {r["row"] for r in rows} <= {"x"}, name
            assert len(rows) <= 2 * frame.count(), name
    # rows that differ in a map only are two documents of the mix
    two = spark.createDataFrame([(1, "a b c", "s", {"k": 1}), (1, "a b c", "s", {"k": 2})], "doc_id long, text string, source string, m map<string,int>")
    assert len(p._marked(two, "x").select("_row", "_row2").distinct().collect()) == 2


def test_known_licences_wrapped(spark):
    """Known texts with their paragraphs wrapped at any width; what only looks like a notice counts."""
    import textwrap

    rows, want = [], []
    for k, t in license_scan.LICENSES.items():
        for width in (50, 61, 72, 88, 100, 10**6):
            rows.append("\n\n".join(textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for x in re.split(r"\n[ \t]*\n", t)))
            want.append(k)
    more = ["(c) You must keep notices.", "(c) You may sell everything.", "licence licence", "license license", "Copyright 2020 A\nx", "x", "copyright notice\nx"]
    frame = spark.createDataFrame(list(enumerate([*rows, *more])), "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan.scan(frame).collect())
    assert [r[2] for r in got[: len(rows)]] == want
    a = [r[1] for r in got[len(rows) :]]
    assert a[0] != a[1] and a[2] == a[3] and a[4] == a[5] != a[6]
    c = duckdb.connect()
    c.register("documents", frame.toPandas())
    assert sorted((r[0], r[1]) for r in c.sql(license_scan.oracle_sql()).fetchall()) == [r[:2] for r in got]


def test_simhash_large_cells_are_cut(spark):
    """Any cell size and number of blocks gives the same components as all pairs."""
    rng = random.Random(14)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(6)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ sum(1 << x for x in rng.sample(range(64), k)) for k in (1, 2, 3) for _ in range(100)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")

    def whole(links):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in signed}

    want = whole((a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for large, blocks in ((8192, None), (5, None), (5, 8), (0, 9)):
        assert whole(tuple(r) for r in simhash.links(frame, large=large, blocks=blocks).collect()) == want
    assert [simhash.blocks_for(10**k) for k in (4, 8, 11, 12)] == [6, 6, 9, 11]
    code = simhash._codes(np.array(signed, np.int64).view(np.uint64))
    got = {r["fp"]: r["v"] for r in frame.select("fp", simhash.embedding(F.col("fp")).alias("v")).collect()}
    assert [got[x] for x in signed] == code.view(np.int64).tolist()
    count = lambda x: [(x >> 2 * s & 3).bit_count() for s in range(32)]
    for (a, u), (b, v) in zip(zip(signed, code.tolist()), zip(signed[7:], code.tolist()[7:])):
        assert (u ^ v).bit_count() == sum(abs(x - y) for x, y in zip(count(a & (1 << 64) - 1), count(b & (1 << 64) - 1)))


def spots(text, chain=2, every=8):
    """The signature of one text in plain Python."""
    import regex
    import xxhash

    digest = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    kept = [(w, w in spotsigs.ANCHORS) for i, w in enumerate(words) if not (w in spotsigs.ANCHORS and i + 1 < len(words) and words[i + 1] in spotsigs.ANCHORS)]
    found = set()
    for i, (w, anchor) in enumerate(kept):
        if anchor or digest(w) % every == 0:
            after = [x for x, a in kept[i + 1 :] if not a][:chain]
            if len(after) == chain:
                found.add(" ".join([w, *after]) + " ")
    if not found and text:
        found = {" ".join(words) if words else text}
    return sorted(digest(s) & 0x7FFFFFFF for s in found)


def test_spotsigs_by_hand(spark, docs, odd):
    """Fingerprints of texts and edited texts, and both likenesses, from the definition; ranges of any size agree."""
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    spell = lambda s: "".join(f"{x:08x}" for x in s)
    for frame in (docs, odd):
        got = {(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.fingerprint_report(frame).collect()}
        rows = sorted(((-1 << 63 if i is None else i), t, i) for i, t in local(frame))
        want = set()
        for k, (_, t, i) in enumerate(rows):
            other, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
            a, b, c = spots(t), spots(t[: len(t) - cut] + other[:cut]), spots(other)
            want.add((i, len(t), spell(a), spell(b), round(alike(a, b), 9), round(alike(a, c), 9)))
        assert got == want
    base = spotsigs.with_next(docs).select("doc_id", "text", "next.text").collect()
    many = spotsigs.with_next(docs, range_bytes=2000).select("doc_id", "text", "next.text").collect()
    assert sorted(base, key=str) == sorted(many, key=str)
    hot = spark.createDataFrame([(7, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    chain = {(r[0], r[1]) for r in spotsigs.with_next(hot, range_bytes=100).select("text", "next.text").collect()}
    assert len({a for a, _ in chain}) == 40 and len([1 for a, b in chain if a != b]) == 40


def test_warc_repeated_rows(spark):
    """Rows that are equal throughout: one response, the others revisit it; the numbers do not hang on the input's order."""
    page = "x" * 1200
    rows = [(1, "u", page), (2, "u", page), (2, "v", page), (2, "v", page), (2, "v", page), (None, "u", page), (None, "u", page), (3, None, None), (3, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.roundtrip(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, "revisit", 2), (2, "revisit", 2), (2, "revisit", 2), (2, "revisit", 2), (2, "response", None), (None, "revisit", 2), (None, "revisit", 2), (3, "response", None), (3, "response", None)], key=str)
    for order in ("url", F.desc("url")):
        plan = warc.plan_captures(frame.orderBy(order).coalesce(1)).where("winner is null and page_id = 2").select("url", "row").collect()
        assert [tuple(r) for r in plan] == [("v", 2)]


def test_a_shared_folder_is_asked_for():
    from claimlens.llm import common

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://somewhere:7077"

            class getConf:
                get = staticmethod(lambda k, d: d)

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)


def test_very_long_texts(spark):
    """One text of over 1 MB: every operator takes it whole."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "a short text of a few words", "en", "s")], "doc_id long, text string, lang string, source string")
    one = lambda df: next(r for r in df.collect() if r["doc_id"] == 1)
    assert one(repetition.repetition_rules(docs))["n_words"] == 200_000
    assert one(bpe.encode_digests(docs))["n_tokens"] > 200_000
    assert one(suffix_dedup.removal_report(docs))["n_bytes"] == len(long)
    assert one(simhash.simhash_components(docs))["fingerprint"] == f"{simhash.fingerprint(long.encode()):016x}"
    assert one(mixing.mix(docs))["size"] == 200_000
    assert one(spotsigs.fingerprint_report(docs))["n_chars"] == len(long)
    assert one(license_scan.scan(docs))["license_id"] is None
    assert one(langid.identify(docs))["doc_id"] == 1
    html = f"<html><body><article><p>{long}</p></article></body></html>"
    page = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert warc.roundtrip(page).first()["payload_bytes"] == len(html) and pages.main_text(page).first()["n_chars"] == len(long)
