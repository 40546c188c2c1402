from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm import fingerprints as fp
from lodestone.llm import html_text
from lodestone.llm.encoding import encoder
from lodestone.llm.html_text import extract, main_text, op4_html_text
from lodestone.llm.language_id import identify, learn, op2_language_id
from lodestone.llm.mixing import OP10_SQL, mix_sources, op10_mix_sources, source_targets
from lodestone.llm.packing import pack, plan_bins
from lodestone.llm.token_counts import TokenTree, edited_counts, op3_token_counts

from .conftest import prose
from .test_dedup import WORD, same_as_sql


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------------------------------------------------- tokens


def test_ids_equal_those_of_tokenizers(spark, sf_dir, tokenizer, odd_rows):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for _, t, *_ in odd_rows if t is not None] + ["a\n\nb  \t c'LL 'll x́", "  \x85", "l'été 日本語 १२३"]
    end = "<|endoftext|>"
    texts += [end, f"x {end} y", f"  {end}{end}\n \n", f"<{end}>", "<|endoftext|", f"{end[:5]}{end}{end[5:]}", "\x1c\x1d a\x1fb"]
    for text in texts:
        assert encoder().encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert "".join(encoder().parts(text)) == text


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + "\r\n\t " * 250_000 + "b", ("x" + " " * 6000) * 3 + "<|endoftext|>" + "\n" * 400_000])
def test_very_long_white_space(frame, tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder().encode(text) == want
    tree = TokenTree(text)
    assert tree.n_tokens == len(want)
    tree.edit(len(text) // 2, len(text) // 2 + 3, "x <|endoftext|>")
    assert tree.n_tokens == len(tokenizer.encode(tree.text, add_special_tokens=False).ids)
    check_packing(pack(frame([(1, text, "en", "s")])).collect(), [(1, text)], tokenizer)


def test_token_tree_follows_edits(tokenizer):
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice(["ab ", "a \n", "ab  1'!t é", "x", ["<|endoftext|>", "<|end", "of", "text|>", " ", "a", "\n"]])
        text = "".join(rng.choices(letters, k=rng.randrange(0, 120)))
        tree = TokenTree(text, leaf=rng.choice([1, 2, 5]))
        for _ in range(4):
            a = rng.randrange(0, len(text) + 2)
            b, new = a + rng.randrange(0, 15), "".join(rng.choices(letters, k=rng.randrange(0, 10)))
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(min(b, len(text)), a) :]
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_edits_encode_little():
    text = " ".join(f"word{k}" for k in range(20_000))
    tree = TokenTree(text)
    built = tree.reencoded
    tree.edit(60_000, 60_003, "new")
    assert built == 0 and tree.reencoded < 2000
    leaves, same = tree.root[1], {id(t) for t in nodes(tree.root)}
    tree.edit(60_000, 60_000, "many words put in " * 40)  # more leaves than before, but few new sums
    assert tree.root[1] > leaves and len([t for t in nodes(tree.root) if id(t) not in same]) < 200
    for k in range(300):
        tree.edit(k * 7, k * 7 + 60, "a b" * (k % 40))
    assert all(abs(t[4][0] - t[5][0]) < 2 for t in nodes(tree.root) if t[0])


def nodes(t):
    yield t
    if t[0]:
        yield from nodes(t[4])
        yield from nodes(t[5])


def test_token_counts(spark, frame, odd_rows, sf_dir, tokenizer):
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("Q ").alias("new")), F.lit(None), F.struct(F.lit(None).cast("int").alias("start"), F.lit(1).alias("end"), F.lit(None).cast("string").alias("new")))
    rows = edited_counts(frame(odd_rows).withColumn("edits", edits)).collect()

    def plain(t):
        n, text = len(tokenizer.encode(t or "", add_special_tokens=False).ids), t or ""
        text = (text[:2] + "Q " + text[5:])[1:]
        return len(t or ""), n, len(text), len(tokenizer.encode(text, add_special_tokens=False).ids)

    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str((d, *plain(t))) for d, t, *_ in odd_rows)
    assert edited_counts(frame([]).withColumn("edits", edits)).count() == 0
    assert op3_token_counts(spark, sf_dir).count() == 200


# ------------------------------------------------------------------------------------------------------- packing


def check_packing(rows, docs, tokenizer, capacity=1024):
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    want = Counter()
    for d, every in ids.items():
        for own in every:
            first = len(own) % capacity or capacity
            starts = [0, *range(first, len(own), capacity)]
            for k, s in enumerate(starts):
                n = first if k == 0 else capacity
                want[d, k, s, n, zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places), sum(n for some in places.values() for _, n in some)


def test_packing_of_odd_rows(frame, odd_rows, tokenizer):
    rows = pack(frame(odd_rows)).collect()
    check_packing(rows, [(d, t) for d, t, *_ in odd_rows], tokenizer)
    assert pack(frame([])).count() == 0


def test_packing_is_tight(spark, sf_dir, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = check_packing(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), docs, tokenizer)
    assert n <= -(-tokens // 1024) * 1.02 + 1


def test_sequences_longer_than_a_short_integer(frame, tokenizer):
    docs = [(1, "a b " * 20_000), (2, "c d " * 10_000), (3, "e " * 90_000)]
    check_packing(pack(frame([(d, t, "en", "s") for d, t in docs]), capacity=40_000).collect(), docs, tokenizer, 40_000)


@pytest.mark.parametrize("mode", ["norm", "dot"])
def test_every_constraint_holds(mode):
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 2000) for n in rng.sample(range(1, 101), 60)}
    capacities = np.array([150.0, 4.0, 10000.0])
    plan = plan_bins(counts, capacities, lambda n: np.array([n, 1, n * n]), np.array([1.0, 1.0, 1.0]), mode)
    assert Counter({n: int(plan[plan[:, 0] == n, 2].sum()) for n in counts}) == Counter(counts)
    bins = defaultdict(list)
    for n, _, many, first, _ in plan.tolist():
        for s in range(first, first + many):
            bins[s].append(n)
    assert all(sum(b) <= 150 and len(b) <= 4 and sum(n * n for n in b) <= 10000 for b in bins.values())


# ------------------------------------------------------------------------------------------------------- mixing


def test_mixing_matches_sql(spark, sf_dir):
    same_as_sql(op10_mix_sources(spark, sf_dir), OP10_SQL, sf_dir)


def test_mixing_of_odd_rows(frame, odd_rows):
    got = mix_sources(frame(odd_rows)).collect()
    again = mix_sources(frame(odd_rows, 7), bins=8).collect()
    assert sorted(map(str, got)) != [] and Counter((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got) == Counter((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in again)
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    sizes = Counter()
    for _, t, _, source in odd_rows:
        sizes[source] += len(WORD.findall(t or ""))
    assert {r["source_size"] for r in got} == set(sizes.values()) and len(got) == len(odd_rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_sources(frame([])).count() == 0


def test_targets_fill_to_their_caps(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 600), ("z", 0)], "_source string, _size long")
    got = {r["_source"]: r["_target"] for r in source_targets(rows, (3, 1, 2), 1.5, 2.0).collect()}
    total, caps, weights = 1.5 * 1615, {"a": 20, "b": 2000, "c": 10, "z": 0, None: 1200}, {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}
    level = 1.0
    for _ in range(200):  # by bisection
        low, high = (0, 1e6) if level == 1.0 else (low, high)
        level = (low + high) / 2
        low, high = (level, high) if sum(min(caps[s], level * w) for s, w in weights.items()) < total else (low, level)
    assert all(abs(got[s] - min(caps[s], level * w)) < 1e-6 for s, w in weights.items())


def test_letters_of_any_script_weigh_alike(frame):
    from lodestone.llm.mixing import letter_share

    rows = [(1, "abc de1", None, None), (2, "где ты1", None, None), (3, "日本 語語語1", None, None), (4, "έναδυ 1", None, None), (5, "12 34", None, None), (6, None, None, None)]
    got = {r[0]: r[1] for r in frame(rows).select("doc_id", letter_share(F.col("text"))).collect()}
    assert {d: round(x, 6) for d, x in got.items()} == {d: round(5 / 6, 6) for d in (1, 2, 3, 4)} | {5: 0.05, 6: 0.05}


def test_heavier_documents_come_first(frame):
    rows = [(d, "w " * 10, "en", "abc"[d % 3]) for d in range(3000)]
    got = mix_sources(frame(rows), quality=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.2))
    share = got.groupBy(F.col("doc_id") % 2).agg(F.sum("copies")).orderBy(F.col("doc_id") % 2).collect()
    assert share[0][1] > 1.2 * share[1][1]


# ------------------------------------------------------------------------------------------------- fingerprints


def jaccard(a: str, b: str, n: int = 5) -> float:
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := WORD.findall(t)) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_edit_likeness(spark, frame, odd_rows, monkeypatch, bucket, sf_dir):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    extra = [(d + 10**9, t) for d, t, *_ in odd_rows if d not in (9, 11, None)]
    rows = [(d, t, "en", "s") for d, t in docs + extra]
    text = {d: t or "" for d, t, *_ in rows}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    errors, prints = [], {}
    got = fp.edit_likeness(frame(rows, 7)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        t, follows = text[r["doc_id"]], text[after[r["doc_id"]]]
        edited = t[: len(t) - len(t) // 3] + follows[: len(t) // 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, follows)]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.06


def plain_fingerprint(text: str) -> str:
    """The fingerprint by one loop over bins, with Spark's 64-bit hash taken from another library."""
    import struct

    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    if not words:
        return ""
    least: dict[int, int] = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        at = (signed(h) >> 57) + 64
        least[at] = min(least.get(at, 2**63), signed(h))
    rng = random.Random(20170806)
    tries = [[rng.randrange(fp.BINS) for _ in range(fp.BINS)] for _ in range(fp.TRIES)]
    codes = []
    for b in range(fp.BINS):
        source = next((x for x in (b, *(t[b] for t in tries)) if x in least), None)
        if source is None:
            rank = lambda x: signed(xxhash.xxh64_intdigest(struct.pack("<q", x), xxhash.xxh64_intdigest(struct.pack("<i", b), 42)))  # noqa: E731, B023
            source = min(least, key=lambda x: (rank(x), least[x]))
        codes.append(least[source] & 255)
    return "".join(f"{c:02x}" for c in codes)


def test_fingerprints_equal_a_plain_version(spark, frame, odd_rows, sf_dir):
    rows = [(d, t, "en", "s") for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [r for r in odd_rows if r[0] not in (9, 11, None)]
    rows = [(k, t, a, b) for k, (_, t, a, b) in enumerate(rows)]
    text = {r[0]: r[1] for r in rows}
    for r in fp.fingerprints(frame(rows)).collect():
        assert r["fingerprint"] == plain_fingerprint(text[r["doc_id"]] or "")


@pytest.mark.parametrize("bucket,ways,sent", [(4, 4, None), (2, 3, 0), (50, 64, 0)])
def test_buckets_follow_the_order_of_any_ids(frame, monkeypatch, bucket, ways, sent):
    """Clustered ids, a frequent id and many null ids: buckets stay small, and every row has the right next one, however rows meet their hosts."""
    monkeypatch.setattr(common, "SENT_ROWS", common.SENT_ROWS if sent is None else sent)
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(fp, "WAYS", ways)
    rng = random.Random(bucket)
    ids = [rng.randrange(10) for _ in range(60)] + [10**12 + rng.randrange(10**6) for _ in range(60)] + [7] * 80 + [None] * 60 + [-(2**62), 2**62]
    rows = [(d, prose(rng, 12), "en", "s") for d in ids]
    docs = frame(rows, 7).select(F.col("doc_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_first"))
    sizes = Counter(r["_bucket"] for r in fp.with_buckets(docs, "doc_id", "_first").collect())
    assert max(sizes.values()) <= 8 * bucket or bucket == 50
    first = {r["_text"]: r["_first"] for r in docs.collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), first[r[1]]))
    want = Counter()
    for (d, t, *_), (_, follows, *_) in zip(order, order[1:] + order[:1], strict=True):
        want[d, hashlib.sha256((t[: len(t) - len(t) // 3] + follows[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fp.edit_likeness(frame(rows, 7)).collect()) == want


def test_fingerprints_of_odd_rows(frame, odd_rows):
    assert fp.edit_likeness(frame(odd_rows)).count() == len(odd_rows)
    assert fp.edit_likeness(frame([])).count() == 0 == fp.fingerprints(frame([])).count()
    one = fp.edit_likeness(frame([(3, "a b c", "en", "s")])).first()
    assert one["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(frame([(1, "", None, None), (2, None, None, None), (3, "a b", None, None), (4, " a\nb", None, None)])).collect()}
    assert plain[1] == plain[2] == "" and plain[3] == plain[4] and len(plain[3]) == 2 * fp.BINS


# --------------------------------------------------------------------------------------------------- language ID


def test_language_id_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    sure = [r for r in rows if not r["rejected"]]
    assert len(sure) > 0.97 * len(rows) and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in sure]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_of_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    learned = learn(docs)
    got = identify(docs, learned).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        text = {d: t for d, t, *_ in odd_rows}.get(r["doc_id"])
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True), text
    assert learn(frame([])) == {} and identify(frame([]), {}).count() == 0
    assert {r["lang_pred"] for r in identify(docs, {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in identify(docs, {"en": learned["en"]}).collect()} == {"und", "en"}


def test_long_texts_are_not_rejected_for_their_length(spark, frame):
    """Texts of one language joined to three million characters are as clear as short ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and n_chars between 200 and 20000")
    texts = sorted({r["text"] for r in docs.select("text").limit(3000).collect()})
    long = "\n".join(texts)[:3_000_000]
    assert len(long) > 2_000_000
    learned = learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = {r["doc_id"]: r for r in identify(frame([(1, long[:20_000], None, None), (2, long, None, None)]), learned).collect()}
    assert all(r["lang_pred"] == "en" and not r["rejected"] for r in rows.values())
    assert rows[2]["score"] > 0.6


def test_language_id_equals_a_plain_version(spark, frame, odd_rows, sf_dir):
    """Sampling, dictionaries, sizes and margins by plain loops over all rows."""
    import xxhash
    import zstandard as zstd

    from lodestone.llm.language_id import BLOCK, DICTIONARY, LEVEL, MARGIN

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()] + odd_rows
    folded = lambda t: " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
    texts, many = defaultdict(dict), Counter()
    for _, t, lang, _ in rows:
        if t is not None and lang is not None:
            many[lang] += 1
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            texts[lang][h - 2**64 if h >= 2**63 else h] = t
    dictionaries = {}
    for lang in sorted(texts, key=lambda x: (-many[x], x)):
        parts = []
        for h in sorted(texts[lang])[:20]:
            t = texts[lang][h]
            at = h % (max(len(t) - 300, 0) + 1)
            parts.append(folded(t[at : at + 300]))
        dictionaries[lang] = "".join(reversed(parts)).encode()[-DICTIONARY:]
    learned = learn(frame(rows, 5), sample_docs=20, sample_chars=300)
    assert learned == dictionaries and list(learned) == list(dictionaries)
    want = Counter()
    for d, t, *_ in rows:
        if not any(c.isalpha() for c in t or ""):
            want[d, "und", 0.0, True] += 1
            continue
        data, sizes = folded(t).encode(), []
        for k, (lang, own) in enumerate(dictionaries.items()):
            shared = zstd.ZstdCompressionDict(own, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            n = 0
            for at in range(0, len(data), BLOCK):
                n += len(zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False).compress(data[at : at + BLOCK]))
            sizes.append((n, k, lang))
        first, second = sorted(sizes)[:2]
        gain = (second[0] - first[0]) / second[0]
        want[d, first[2], gain / (gain + 2 * MARGIN), gain < MARGIN] += 1
    assert Counter(tuple(r) for r in identify(frame(rows, 5), learned).collect()) == want


def test_marks_stay_with_their_letters(frame):
    from lodestone.llm.language_id import letters_only

    assert letters_only("हिन्दी भाषा, x\u0301Y2 \u0301 _1") == " हिन्दी भाषा x\u0301y "
    assert letters_only("\u0301 12") == letters_only("") == "  "
    hindi, marathi = "यह हिन्दी भाषा का एक छोटा पाठ है और इसमें कुछ शब्द हैं", "हा मराठी भाषेतील एक छोटा मजकूर आहे आणि त्यात काही शब्द आहेत"
    rows = [(i, f"{hindi} {'अआइउ'[i % 4]}", "hi", None) for i in range(4)] + [(10 + i, f"{marathi} {'अआइउ'[i % 4]}", "mr", None) for i in range(4)]
    learned = learn(frame(rows), sample_docs=4)
    said = {r["doc_id"]: r["lang_pred"] for r in identify(frame([(1, hindi[5:40], None, None), (2, marathi[3:40], None, None), (3, "\u0902\u0902", None, None)]), learned).collect()}
    assert said == {1: "hi", 2: "mr", 3: "und"}


def test_copies_count_once_in_the_sample(frame):
    """A language of few texts that are copied often is learned, and one copied text can't take all places."""
    rows = [(i, f"wort {'ab'[i % 2]} und noch eines", "de", None) for i in range(600)] + [(1000 + i, f"word {'abcdefghij'[i]} and more of it", "en", None) for i in range(10)]
    learned = learn(frame(rows), sample_docs=4)
    assert list(learned) == ["de", "en"]
    assert learned["de"].decode().count("wort") == 2 and learned["en"].decode().count("word") == 4


# ---------------------------------------------------------------------------------------------------------- HTML


def test_pages_give_their_articles(spark, sf_dir):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op4_html_text(spark, sf_dir).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search("<article>(.*)</article>", source[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|<h1>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


LONG = "word " * 40


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a &lt;b&gt; &nbsp; c<br>d", "a <b> c d"),
        (f"<body><nav>menu</nav><div class='ad'>buy</div><article><h1>T</h1><p>{LONG}</p><p>Be.</p></article><footer>f</footer>", f"T\n\n{LONG.strip()}\n\nBe."),
        (f"<article><header><h1>T</h1><p>by x</p></header><p>{LONG}<aside>side</aside> tail</p><form>q</form><div class='comments'>{LONG}</div></article>", f"T\n\n{LONG.strip()}\n\ntail"),
        (f"<main><section><p>{LONG}</p></section><section id='comment-list'><p>{LONG}</p></section></main>", LONG.strip()),
        (f"<div><a href=1>Home</a> <a href=2>About us</a></div><div><h2>T</h2><p>{LONG}</p><p>x <span class='ad'>buy</span> y</p></div>", f"T\n\n{LONG.strip()}\n\nx y"),
        (f"<div class='content with-sidebar'><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></div><div class=sidebar><p>{LONG}</p></div>", f"{LONG.strip()}\n\na b\n\nc"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes</p>", "yes"),
        (f"<article><p><b>{LONG}<br><p>{LONG}</article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p><article><p>note</p></article></main>", f"T\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nnote"),
        (f"<body><article><p>short teaser</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<main><h1>T</h1><article><p>{LONG}</p><p>Be.</p></article><div><a href=1>x</a></div></main>", f"T\n\n{LONG.strip()}\n\nBe."),
        (f"<article><section><p>{LONG}</p><p>{LONG}</p></section><p>Be.</p></article>", f"{LONG.strip()}\n\n{LONG.strip()}\n\nBe."),
        (f"<article><h2>a</h2><p>{LONG}</p></article><article><h2>x</h2><p><a href=1>more</a></p><p>hi</p></article>", f"a\n\n{LONG.strip()}"),
    ],
)
def test_ratios_choose_the_region(page, text):
    """Text outside an article or main element stays, and an article isn't content for its tag."""
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p>{LONG}</p><ul><li><a href=1>Report one</a><li><a href=2>Report two</a><li>Report <a href=3>three</a><li><a href=4>Four</a></ul></article>", f"{LONG.strip()}\n\nReport one\n\nReport two\n\nReport three\n\nFour"),
        (f"<article><p>{LONG}</p><div class='related-work'><p>{LONG}</p></div></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><section id='legal'><p>{LONG}</p></section></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p class='share-price'>Up by two.</p></article>", f"{LONG.strip()}\n\nUp by two."),
        (f"<article><p>{LONG}</p><div class='legal'>All rights kept.</div><div class='related'><a href=1>More of this</a></div></article>", LONG.strip()),
        (f"<article><div class='entry-header'><h1>T</h1></div><p>{LONG}</p><div class='share-bar'>Send</div></article>", f"T\n\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div><div id='ad-slot-3'><p>{LONG}</p></div></div>", LONG.strip()),
    ],
)
def test_an_articles_own_text_stays(page, text):
    """Lists of links and parts whose class shares a word with menus and the like; what is thin there goes."""
    assert main_text(page) == text


def test_the_threshold_decides_about_likely_parts(monkeypatch):
    page = f"<article><p>{LONG}</p><div class='legal'>All rights kept.</div><section class='legal'><p>{LONG}</p></section></article>"
    assert main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"
    monkeypatch.setattr(html_text, "_threshold", lambda values: -1.0)
    assert main_text(page) == f"{LONG.strip()}\n\nAll rights kept.\n\n{LONG.strip()}"
    monkeypatch.setattr(html_text, "_threshold", lambda values: 1e9)
    assert main_text(page) == LONG.strip()


PLAIN_PAGES = [
    (f"<div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Help</a></div><div><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div><div>Site 2020 <a href=1>Privacy</a> <a href=2>Terms</a></div>", ["T", LONG, LONG]),
    (f"<table><tr><td><a href=1>x</a><br><a href=2>y</a><br><a href=3>z</a></td><td><p>{LONG}</p><p>Be.</p><p>{LONG}</p></td></tr><tr><td><font size=1>made with care</font></td></tr></table>", [LONG, "Be.", LONG]),
    (f"<center><b>Site</b></center><hr><h1>T</h1><p>{LONG}<p>{LONG}<hr><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><small>last change</small>", ["T", LONG, LONG]),
    (f"<div><div><span>Log in</span></div><div><div><p>{LONG}</p><blockquote>{LONG}</blockquote><p>{LONG}</p></div><div><b>More</b><ul><li><a href=1>one more thing</a></li><li><a href=2>another</a></li></ul></div></div></div>", [LONG, LONG, LONG]),
]


@pytest.mark.parametrize("page,blocks", PLAIN_PAGES)
def test_ratios_alone_find_the_text(page, blocks, monkeypatch):
    """Pages without a telling element or class: the threshold decides, and without it menus and the like stay."""
    want = "\n\n".join(b.strip() for b in blocks)
    assert main_text(page) == want
    monkeypatch.setattr(html_text, "_threshold", lambda values: -1.0)
    assert main_text(page) != want


@pytest.mark.parametrize(
    "page,text",
    [("<p>a<![foo[ b</p>c", "ac"), ("<p>a</p><!-- x", "a"), ("<?php x", ""), ("<p>a<b x", "a"), ("a &#" + "9" * 5000 + "; b", "a \ufffd b"), ("a &#" + "0" * 5000 + "65; b", "a A b"), ("<p>x <a$ y='>'>z</a>", "x z"), ("<a / b>c", "c"), ("<![CDATA[ a > b", "b"), ("a < b &amp", "a < b &")],
)
def test_malformed_markup_is_never_text(page, text):
    assert main_text(page) == text


def test_any_markup_is_read_in_linear_time():
    rng = random.Random(4)
    bits = ["<", "</", ">", "<!--", "-->", "<![", "]]>", "<?", "p", "article", "b", "td", "li", " ", "=", "'", '"', "/", "&#", "x9", ";", "text ", "<script>", "<p>", "</div>", "<div>", "<li>", "</i>", "\0", "<svg>"]
    for _ in range(5000):
        main_text("".join(rng.choices(bits, k=rng.randrange(40))))
    n = 100_000
    for page in ("<div>" * n, "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p><b>" * n, "<ul><li>" * n, "<" * n, "<a " * n, "</a" * n, "<a " + 'x="' * n, "&#" * n):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 15


def test_pages_of_any_kind(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "x"), (2, "u", "<div>" * 3000 + "deep", "x"), (3, "v", "<<<>>&&;<a b='", "x")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert sorted(str((r["page_id"], r["text"])) for r in rows if r["page_id"] != 3) == sorted(map(str, [(1, ""), (1, ""), (None, "a"), (2, "deep")]))
    assert extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------- very long texts


def test_very_long_texts(frame, tokenizer):
    """Two hundred thousand words: every operator reads them whole."""
    from lodestone.llm.exact_dedup import exact_dedup
    from lodestone.llm.near_dedup import near_groups
    from lodestone.llm.personal_data import find_personal_data
    from lodestone.llm.substring_dedup import repeated_words

    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    long, other = " ".join(words), " ".join([*words[:-200], "x", *words[-199:]])
    end = " ".join(words[-100:])
    docs = frame([(1, long, "en", "a"), (2, other, "en", "a"), (3, long + "\n", "en", "b"), (4, end + " mail a@b.org", "en", "b")]).cache()
    by = lambda df, *c: {r["doc_id"]: tuple(r[x] for x in c) for r in df.collect()}
    assert by(near_groups(docs), "component_id") == {1: (1,), 2: (1,), 3: (1,), 4: (4,)}
    assert by(exact_dedup(docs), "keep_id", "group_size") == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
    assert by(repeated_words(docs), "n_removed") == {1: (0,), 2: (199_999,), 3: (200_000,), 4: (100,)}
    assert by(find_personal_data(docs), "n_email") == {1: (0,), 2: (0,), 3: (0,), 4: (1,)}
    assert by(mix_sources(docs), "size") == {1: (200_000,), 2: (200_000,), 3: (200_000,), 4: (102,)}
    prints = by(fp.fingerprints(docs), "fingerprint")
    assert prints[1] == prints[3] == (plain_fingerprint(long),) and prints[2] == (plain_fingerprint(other),)
    likeness = by(fp.edit_likeness(docs), "near_next", "n_chars")
    assert likeness[3][0] > 0.9 and likeness[1][1] == len(long)
    prose_ = " ".join(rng.choice("the word of and in it was on a by which they".split()) for _ in range(200_000))
    learned = {"de": b"und der die das ist von mit auf ein sie nicht wort " * 20, "en": b"the word of and in it was on a by which they " * 20}
    assert by(identify(frame([(1, prose_, None, None)]), learned), "lang_pred") == {1: ("en",)}
    n = len(tokenizer.encode(long, add_special_tokens=False).ids)
    edits = F.array(F.struct(F.lit(5).alias("start"), F.lit(5).alias("end"), F.lit("").alias("new")))
    assert by(edited_counts(docs.withColumn("edits", edits)), "n_tokens")[1] == (n,)
    assert sum(r["length"] for r in pack(docs.where("doc_id = 1")).collect()) == n + 1
    page = f"<body><div><p>{long}</p></div><nav>menu</nav></body>"
    assert main_text(page) == long


# ------------------------------------------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, sf_dir, tokenizer):
    import corpus_pipeline as p

    from .test_dedup import brute_near

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        seen[name] = (before, docs)
    rows = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, (a, b) in seen.items()}
    before, after = rows["language ID"]
    assert len(after) > 0.97 * len(before) and not Counter(after) - Counter(before)
    before, after = rows["exact dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in before:
        best[norm(r[1])] = min(best.get(norm(r[1]), (0, 10**18)), (-len(r[1] or ""), r[0]))
    assert sorted(r[0] for r in after) == sorted(d for _, d in best.values())
    before, after = rows["near dedup"]
    kept = [x for x in brute_near(before, 5) if x.endswith("True)")]
    assert len(after) == len(kept)
    before, after = rows["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(seen["mixing"][0]).collect()}
    assert Counter(r[0] for r in after) == Counter({d: c for d, c in copies.items() if c}) and set(after) <= set(before)
    packed = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(packed, [(r[0], r[1]) for r in after], tokenizer)
    assert p.ORACLE_SQL is None


def test_pipeline_of_no_rows(frame, spark, sf_dir):
    import corpus_pipeline as p

    docs = frame([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, sf_dir))
    assert docs.count() == 0
