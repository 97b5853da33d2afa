"""The operators against brute force, exact round trips, held-out accuracy or SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mnemoria.llm import decontaminate, edits, kernel, language_id, license_scan, line_dedup, line_pairs, quality_rules, registry, sentencepiece, sharding, simhash_dedup, span_dedup, sstable
from mnemoria.llm.license_texts import TEMPLATES
from tests.llm import brute
from tests.oracle import connect, rows_of

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "po", "ru", "sa", "ti") for b in ("bel", "dor", "fin", "gar", "hul", "jet", "kon", "lam")]


def sentence(rng, n=9):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1 license scans


def license_texts():
    rng = random.Random(1)
    out = []
    for i, (_, t) in enumerate(TEMPLATES):
        w = t.replace("{", "").replace("}", "").replace("<>", "the project").split(" ")
        if len(w) > 12:
            for _ in range(len(w) // 15):  # a few words changed, added and left out
                at = rng.randrange(3, len(w) - 1)
                w[at : at + 1] = rng.choice(([], ["changed"], [w[at], "added"]))
        out.append((i, sentence(rng) + " " + " ".join(w) + " " + sentence(rng)))
    return out + [(100, sentence(rng, 200)), (101, "the license of the software version"), (102, None)]


def test_license_scan_equals_whole_alignment(spark):
    docs = license_texts()
    found = {}
    for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["license"], r["matched_words"]))
    for i, text in docs:
        whole = brute.licenses(text, TEMPLATES)
        if not whole:
            assert i not in found
            continue
        best = max(n for _, n in whole)
        assert (next(name for name, n in whole if n == best), best) in found[i], i
        assert set(found[i]) <= set(whole)


def test_license_spans(spark):
    text = "Ärger! Released under the\nMIT License. Some more text here. Licensed under CC BY-NC 4.0. End"
    rows = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r["license"], text[r["start"] : r["end"]]) for r in rows] == [("MIT-reference", "Released under the\nMIT License"), ("CC-BY-NC-4.0-reference", "Licensed under CC BY-NC 4.0")]
    assert all(r["coverage"] == 1.0 and len(r["spans"]) == 1 for r in rows)


def test_license_lines_of_documents_are_found(spark, sf):
    docs = documents(spark, sf)
    lines = {r[0] for r in docs.where("text rlike '(?i)licensed under|released under the'").select("doc_id").collect()}
    assert {r["doc_id"] for r in license_scan.scan(docs).collect()} == lines and lines


# 2 span dedup


def passages():
    rng = random.Random(2)
    shared = [" ".join(sentence(rng, rng.randint(3, 14)) for _ in range(6)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [sentence(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        docs.append((i, rng.choice((" ", "\n")).join(parts)))
    return docs + [docs[3], (50, docs[3][1]), (51, ""), (52, None), (None, shared[0])]


@pytest.mark.parametrize("least, alone", [(span_dedup.MIN_WORDS, span_dedup.ALONE), (20, 20), (9, 12)])
def test_span_dedup_equals_every_run(spark, least, alone):
    docs = passages()
    gone = brute.repeated_sentences(docs, least, alone)
    out = span_dedup.removals(spark.createDataFrame(docs, "doc_id long, text string"), least=least, alone=alone).collect()
    text_of = {}
    for i, t in docs:
        text_of.setdefault(i, t)
    assert {r["doc_id"] for r in out} == {k[0] for k in gone}
    for r in out:
        key = (r["doc_id"], text_of[r["doc_id"]])
        all_ = brute.sentences(key[1])
        assert r["n_sentences"] == len(all_) and r["n_removed"] == len(gone[key])
        assert brute.words(r["text"]) == [w for n, s in enumerate(all_) if n not in gone[key] for w in s]


def test_passages_cut_inside_sentences_lose_their_spans(spark):
    rng = random.Random(5)
    docs = []
    for n in range(10):
        words = " ".join(" ".join(sentence(rng, 14) for _ in range(5)).split(" ")[8:60])  # begins and ends in mid-sentence
        docs += [(2 * n + k, f"{sentence(rng, 9)} {sentence(rng, 4)[:-1]} {words} {sentence(rng, 6)}") for k in (0, 1)]
    out = span_dedup.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == set(range(1, 20, 2))


# 3 sorted-string tables


def test_sstable_round_trip(spark, sf):
    docs = documents(spark, sf)
    parts = sstable.build(docs, target=100_000).cache()
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect())
    read, last = [], b""
    for _, t in sstable.tables(parts):
        keys = [k for k, _ in t]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
        read += [(k, tuple(v)) for k, v in t]
    assert [v for _, v in read] == [r[1:] for r in rows] and [k for k, _ in read] == [sstable.key_bytes(r[0]) for r in rows]
    some = [rows[0][0], rows[-1][0], rows[77][0], -5, 10**12]
    got = sstable.lookup(parts, some)
    assert {k: sorted(map(tuple, v)) for k, v in got.items()} == {k: sorted(r[1:] for r in rows if r[0] == k) for k in some}
    assert parts.select("shard_id").distinct().count() > 1


def test_sstable_files(spark, sf, tmp_path):
    parts = sstable.build(documents(spark, sf), target=200_000)
    sstable.write(parts, str(tmp_path))
    tables = [sstable.Table(p.read_bytes()) for p in sorted(tmp_path.iterdir())]
    assert sum(t.count for t in tables) == documents(spark, sf).count()
    one = documents(spark, sf).first()
    assert any(one["text"] in v for t in tables for v in t.get(one["doc_id"]))
    keys = [sstable.key_bytes(i) for i in range(10**6, 10**6 + 2000)]
    assert np.mean([sstable.maybe(tables[0].filter, k) for k in keys]) < 0.03
    broken = bytearray(sorted(tmp_path.iterdir())[0].read_bytes())
    broken[10] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Table(bytes(broken)))


# 4 near duplicates


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(300)]

    def sign(part):
        w = kernel.Words(kernel.lower(pa.array(part)))
        h, first = kernel.distinct_by_row(w.hash, w.row, len(part))
        return kernel.simhash(h, first, 4).tolist()

    assert sign(texts) == [x for t in texts for x in sign([t])]


def test_simhash_groups_against_all_pairs(spark, sf):
    signed = simhash_dedup.signatures(documents(spark, sf))
    own = [(r["id"], r["th"], bytes(r["sig"])) for r in signed.distinct().orderBy("id", "th").collect()]
    root = brute.near_groups([s for *_, s in own], simhash_dedup.MAX_DISTANCE)
    want = {(own[i][:2], own[r][:2]) for i, r in enumerate(root) if i != r}
    got = {((r["id"], r["th"]), (r["first_id"], r["first_th"])) for r in simhash_dedup.groups(signed).collect()}
    got = {p for p in got if p[0] != p[1]}
    assert want and len(got & want) >= 0.9 * len(want)
    assert {a for a, _ in got} <= {a for a, _ in want}
    assert len({own[i][:2] for i in range(len(own))}) - len({a for a, _ in got}) == simhash_dedup.keep_first(documents(spark, sf)).distinct().count()


def test_simhash_large_bucket_is_whole(spark):
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(400)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(400)] = f"new{i}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for cap in (4096, 32):
        assert simhash_dedup.near_duplicates(frame, cap=cap).where("duplicate_of = 0 and group_size = 300").count() == 299


# 5 SentencePiece


def test_codec_equals_sentencepiece(spark, sf):
    import sentencepiece as reference

    theirs = reference.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    docs = documents(spark, sf).collect()
    more = [(-1, "  two  blanks "), (-2, "▁mark ▁"), (-3, "日本語 \U0001f600 \t tab\r\n"), (-4, " "), (-5, "x" * 5000), (-6, "é ﬁ")]
    rows = [(r["doc_id"], r["text"]) for r in docs] + more
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    data = sentencepiece.load(sentencepiece.MODEL)
    tokens = sentencepiece.encoded(frame, data).cache()
    for (_, text), got in zip(sorted(rows), [r for r in tokens.orderBy("doc_id").collect()]):
        assert list(got["ids"]) == theirs.encode(text), text[:40]
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decoded(tokens, data).collect()}
    assert all(back[i] == t for i, t in rows if "▁" not in t)


def proto(*fields) -> bytes:
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            import struct

            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += sstable.varint(number << 3) + sstable.varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += sstable.varint(number << 3 | 2) + sstable.varint(len(value)) + value
    return out


def unigram_model() -> bytes:
    """A model written by hand: pieces with scores, byte fallback and the identity normaliser."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [("▁", -3.0, 1), *((c, -6.0 - i / 50, 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"))]
    pieces += [(p, -2.0 - i / 7, 1) for i, p in enumerate(["▁the", "▁a", "ing", "er", "▁th", "an", "ed", "▁re", "st", "on", "tion", "▁of", "en", "he"])]
    body = b"".join(proto((1, proto((1, p), (2, s), (3, k)))) for p, s, k in pieces)
    trainer = proto((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, -1 & (2**64 - 1)))
    return body + proto((2, trainer), (3, proto((1, "identity"), (3, 1), (4, 1), (5, 1))))


def test_unigram_parity(spark, sf):
    import sentencepiece as reference

    data = unigram_model()
    theirs = reference.SentencePieceProcessor(model_proto=data)
    texts = [r["text"] for r in documents(spark, sf).where("lang = 'en'").orderBy("doc_id").collect()][:60] + ["", "  the  stoner ", "日本 the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [list(r["ids"]) for r in sentencepiece.encoded(frame, data).orderBy("doc_id").collect()]
    score = {i: theirs.get_score(i) for i in range(theirs.get_piece_size())}
    for ids, text in zip(got, texts):
        want = theirs.encode(text)
        assert ids == want or abs(sum(score[i] for i in ids) - sum(score[i] for i in want)) < 1e-3, text[:50]


# 6 decontamination

ITEM = "A farmer named Tom has 12 cows and sells 5 of them to Anna for 300 dollars. How many cows does Tom have left?"
CASES = {
    1: "Here it is: " + ITEM + " Thanks.",
    2: "Some text. A farmer named Bob has 40 cows and sells 7 of them to Mary for 90 euros. How many cows does Bob have left? Done.",
    3: "Some text. A farmer named Bob has 40 cows and sells 7 of them to Mary for 90 euros. How many cows does Carl have left? Done.",
    4: "Nothing to see in this text about a river and a hill that are far away from here.",
    5: ITEM.upper(),
    6: None,
    7: "A farmer named Tom",
}


def test_decontamination_cases(spark):
    docs = spark.createDataFrame(list(CASES.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short")], "item_id long, text string")
    hit = {r["doc_id"]: r for r in decontaminate.leaks(docs, items).collect()}
    assert set(hit) == {i for i, t in CASES.items() if brute.leaks(t, ITEM)} and {1, 2, 5} <= set(hit) and not {4, 6, 7} & set(hit)
    assert hit[1]["changed_slots"] == 0 and hit[2]["changed_slots"] > 0 and hit[1]["coverage"] == 1.0
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == set(CASES) - set(hit)


def test_decontamination_of_documents_against_every_pair(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if len(d["text"]) < 1500 and brute.leaks(d["text"], i["text"])}
    short = {r["doc_id"] for r in docs.where("length(text) < 1500").collect()}
    assert {g for g in got if g[0] in short} == want and got


# 7 line dedup


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(5, 20)) for _ in range(25)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(base)
            if rng.random() < 0.5:
                at = rng.randrange(len(s) - 1)
                s = s[:at] + rng.choice("xyz") + s[at + 1 :]
            lines.append(s.upper() if rng.random() < 0.2 else s)
        docs.append((i, "\n".join(lines)))
    docs += [(40, "short\nshort\n\nshort"), (41, None), (42, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    place, form = [], []
    for i, t in docs:
        if not t:
            continue
        for n, line in enumerate(t.split("\n")):
            if w := brute.words(line):
                place.append((i, n))
                form.append(" ".join(w))
    root = brute.line_groups(form, 0.9)
    want = {place[n] for n, r in enumerate(root) if n != r}
    got = {(r["id"], r["line"]) for r in line_dedup.duplicate_lines(frame).collect()}
    assert got == want and want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean(frame).collect()}
    for i, t in docs:
        assert kept[i] == (t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "日本語éa"])
def test_edit_distances(letters):
    """Pairs one by one and many at once, on both sides of a block's 64 characters."""
    rng = random.Random(8)
    a, b = [], []
    for n in range(150):
        x = [rng.choice(letters) for _ in range(rng.randint(0, 12) if n < 50 else rng.randint(40, 150))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 6))):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choice(([], [rng.choice(letters)]))
        a.append("".join(x))
        b.append("".join(y))
    want = [brute.edit(x, y) for x, y in zip(a, b)]
    assert [edits.distance(x, y) for x, y in zip(a, b)] == want
    some = [n for n in range(150) if a[n] and b[n]]
    assert edits._together([edits.codes(a[n]) for n in some], [edits.codes(b[n]) for n in some]).tolist() == [want[n] for n in some]
    near = edits.similar_pairs(a, b, 0.9).tolist()
    assert near == [d <= 0.1 * max(len(x), len(y)) + 1e-9 for x, y, d in zip(a, b, want)] and 0 < sum(near) < 150


@pytest.mark.parametrize("size", [1000, 1024, 1100, 1990, 2010, 5000])
def test_edit_similarity_is_one_measure_at_every_length(size):
    rng = random.Random(size)
    x = [rng.choice("abcdefgh ") for _ in range(size)]
    y = list(x)
    for at in rng.sample(range(size), size // 10):
        y[at] = "z"
    assert edits.similar("".join(x), "".join(y), 0.9)
    for at in [n for n in range(size) if y[n] != "z"][:3]:
        y[at] = "z"
    assert not edits.similar("".join(x), "".join(y), 0.9)


# 8 sharding


@pytest.mark.parametrize("target", [5_000, 60_000, 10**9])
def test_shards_are_ranges_of_their_size(spark, sf, target):
    docs = documents(spark, sf)
    rows = [(r["source"], r["doc_id"], r["shard_id"], len(r["text"].encode()) + sharding.OVERHEAD) for r in sharding.shard(docs, target=target).collect()]
    assert sorted((s, d) for s, d, *_ in rows) == sorted((r["source"], r["doc_id"]) for r in docs.collect())
    by = {}
    for s, _, shard, n in rows:
        by.setdefault(shard, []).append((s, n))
    assert sorted(by) == list(range(len(by)))
    ranges = [(min(s for s, _ in by[k]), max(s for s, _ in by[k])) for k in sorted(by)]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    for v in by.values():  # only a record above the target may make a shard too full
        assert sum(n for _, n in v) <= sharding.SLACK * target or max(n for _, n in v) > target / 2, v


# 9 language


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(test, language_id.trained(train)).collect()}
    own = {r["doc_id"]: r["lang"] for r in test.where("length(text) >= 200").collect()}
    assert np.mean([got[i] == x for i, x in own.items()]) > 0.9


def test_presence_kernel():
    rng = random.Random(9)
    texts = ["The cat, the Hat!", "das Haus", "", "?!", "ñ", *(sentence(rng) for _ in range(10))]
    x = language_id.presence(kernel.lower(pa.array(texts)))
    n = np.sqrt(np.maximum(x.sum(1), 1))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(float(x[i] @ x[j]) / (n[i] * n[j]) - brute.kernel(a, b)) < 0.03


# 10 quality rules


def test_quality_equals_sql(spark, sf):
    con = connect(sf)
    for name, sql in registry.SQL.items():
        assert rows_of(registry.QUERIES[name](spark, sf).toPandas()) == rows_of(con.execute(sql).fetchdf()), name
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_quality_rules_one_by_one():
    lines = {
        "Home | About | Contact": True,
        "We use cookies: see our privacy policy.": True,
        "A short line": True,
        "A short line.": False,
        "THIS WHOLE LINE IS SHOUTING AT EVERYONE WHO READS IT.": True,
        "wow!!! so good!": True,
        "An ordinary sentence of more than eight words stands on this line": False,
        "": False,
        "spam " * 30: True,
    }
    bad, _ = quality_rules.failing("\n".join(lines))
    assert dict(zip(lines, bad.tolist())) == lines


def test_line_dedup_finds_similar_lines(spark):
    """Recall over all pairs of edit similarity 0.9, without a condition on signatures."""
    rng = random.Random(9)
    forms = []
    for _ in range(80):
        s = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 25)))
        t = list(s)
        for _ in range(rng.randint(1, len(s) // 10)):
            t[rng.randrange(len(t))] = rng.choice("abcdefghijklmnop")
        forms += [s, " ".join("".join(t).split())]
    forms = [f for f in forms if len(f) >= line_dedup.MIN_BYTES]
    root = brute.line_groups(forms, 0.9)
    want = {i for i, r in enumerate(root) if i != r}
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = {r["id"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50
    words = " ".join(rng.choice(VOCABULARY) for _ in range(30))
    docs = spark.createDataFrame([(1, words), (2, words[:50] + "z" + words[51:])], "doc_id long, text string")
    assert [r["id"] for r in line_dedup.duplicate_lines(docs).collect()] == [2]


def test_line_dedup_collapses_short_lines(spark):
    docs = [(1, "All rights reserved\n版权所有不得转载本站文章内容"), (2, "all RIGHTS reserved!\n---\nok\n版权所有不得转载本站文章内容\nOK\n---")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "---\nok\n---"}


def test_line_dedup_compares_crowded_buckets_by_parts(spark, monkeypatch):
    """A template's lines share all their blocks: the groups are those of all pairs, in one part or in several, split or whole."""
    rng = random.Random(10)
    words = [rng.choice(VOCABULARY) for _ in range(12)]
    forms = [" ".join([*words[:6], "".join(rng.choice("abcdefghij") for _ in range(rng.choice((2, 12)))), *words[6:]]) for _ in range(150)]
    forms = list(dict.fromkeys(forms))
    root = brute.line_groups(forms, 0.9)
    want = {i for i, r in enumerate(root) if i != r}
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    assert {r["id"] for r in line_dedup.duplicate_lines(docs).collect()} == want and 50 < len(want) < len(forms) - 1
    probed = [b for b in line_dedup._probe(np.zeros(0, np.uint64), np.zeros(0, np.uint64))(iter([pa.RecordBatch.from_pydict({"text": forms})]))]
    rows = pa.Table.from_batches(probed).sort_by([("bucket", "ascending"), ("size", "ascending")]).combine_chunks().to_batches()
    monkeypatch.setattr(line_dedup, "PART", 20)
    met = set()
    linked = pa.Table.from_batches(line_dedup._link(iter(rows))).to_pylist()
    parts = {}
    for r in linked:
        if r["part"] is not None:
            parts.setdefault(r["part"], set()).add(r["a"])
        else:
            met.add((r["a"], r["b"]))
    assert parts and max(map(len, parts.values())) <= 40
    met |= {(x, y) for p in parts.values() for x in p for y in p if x < y}
    lines = kernel.Lines(kernel.Words(pa.array(forms)))
    h = {x: k for k, x in enumerate(line_dedup._hashes(lines, np.arange(len(forms)), False)[0].view(np.int64).tolist())}
    assert len(h) == len(forms) and lines.words.min() == 13
    root = brute.grouped(len(forms), ((h[x], h[y]) for x, y in met if edits.similar(forms[h[x]], forms[h[y]], 0.9)))
    assert {i for i, r in enumerate(root) if i != r} == want


def test_line_dedup_splits_hot_buckets(spark):
    """With a bound of 4 lines every bucket of these counts as hot; equal and very similar lines are found all the same."""
    rng = random.Random(11)
    base = [" ".join(rng.choice(VOCABULARY) for _ in range(14)) for _ in range(40)]
    texts = [s for s in base for _ in range(8)]
    texts = [f"{t[:n]}z{t[n + 1 :]}" for t in texts for n in (rng.randrange(len(t)),)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"] for r in line_dedup.duplicate_lines(docs, hot=4).collect()}
    root = brute.line_groups(texts, 0.9)
    want = {i for i, r in enumerate(root) if i != r}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_sstable_values_of_all_types(spark):
    import datetime as dt
    from decimal import Decimal

    schema = "doc_id long, d date, t timestamp, x decimal(20,3), m map<string,int>, a array<string>, ids array<int>, f float, b binary, s struct<u:int>, n void"
    day, at = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(1, day, at, Decimal("1.5"), {"k": 1}, ["x", None], [7, 70_000], 0.5, b"\x00", (3,), None), (1, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sstable.lookup(sstable.build(docs), [1, 2])
    assert sorted(got[1], key=str) == sorted([["2024-01-02", "2024-01-02 03:04:05", "1.500", '{"k":1}', '["x",null]', [7, 70_000], 0.5, b"\x00", '{"u":3}', None], [None] * 10], key=str) and got[2] == []
    same = [[r["payload"] for r in sstable.build(docs.repartition(n)).orderBy("shard_id", "part").collect()] for n in (1, 3)]
    assert same[0] == same[1]  # equal keys have an order
    assert list(sstable.lookup(sstable.build(docs.select("d", "x"), "d"), ["2024-01-02"]).values()) == [[["1.500"]]]
    for key in ("f", "x", "m"):
        with pytest.raises(TypeError):
            sstable.build(docs, key)


def test_license_copies_side_by_side(spark):
    one = "SPDX-License-Identifier: MIT"
    rows = license_scan.scan(spark.createDataFrame([(1, f"{one}\n{one}\nSome other words stand here. {one}")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and len({r["start"] for r in rows}) == 3


def test_shards_are_cut_beside_a_hot_key(spark):
    """One key, equal in all, has nearly all bytes: what stands beside it is cut off, in however many rounds."""
    docs = spark.createDataFrame([(7, "s", "x" * 100)] * 3000 + [(i, "s", "y") for i in range(8, 40)], "doc_id long, source string, text string")
    rows = sharding.shard(docs, target=2000).select("doc_id", "shard_id").collect()
    hot = {r["shard_id"] for r in rows if r["doc_id"] == 7}
    assert len(rows) == 3032 and len(hot) == 1 and len({r["shard_id"] for r in rows} - hot) >= 1


def _edited(rng, s: str, edits: int) -> str:
    t = list(s)
    for _ in range(edits):
        at, kind = rng.randrange(len(t)), rng.random()
        t[at : at + (kind < 0.7)] = rng.choice(["x", "y", "z"]) if kind > 0.3 else ""
    return " ".join("".join(t).split())


def test_line_dedup_leaves_no_link_out(spark):
    """Edits spread evenly leave no block of 8 or 12 bytes whole in most pairs; every one is found."""
    rng = random.Random(12)
    forms = []
    for n in (20, 29, 30, 41, 60, 90, 120, 200, 350):
        for _ in range(6):
            s = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
            t = list(s)
            for k in range(n // 10):
                t[n * (2 * k + 1) // (2 * (n // 10))] = rng.choice("xyz")
            forms += [s, "".join(t), _edited(rng, s, n // 10)]
    forms = list(dict.fromkeys(f for f in forms if len(f) >= line_dedup.MIN_BYTES))
    root = brute.line_groups(forms, 0.9)
    want = {i for i, r in enumerate(root) if i != r}
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    assert {r["id"] for r in line_dedup.duplicate_lines(docs).collect()} == want and len(want) > 100


def test_line_dedup_loses_nothing_in_crowded_groups(spark):
    """Lines of one template, far apart by words where letters change in most of them, near by edits."""
    rng = random.Random(14)
    forms = []
    stem = [rng.choice(VOCABULARY) for _ in range(14)]
    for _ in range(40):  # a template with a letter changed in most words: far apart by words, and some near by edits
        t = " ".join(stem)
        forms += [t := _edited(rng, t, 5), _edited(rng, t, len(t) // 10)]
    forms = list(dict.fromkeys(forms))
    root = brute.line_groups(forms, 0.9)
    want = {i for i, r in enumerate(root) if i != r}
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    assert {r["id"] for r in line_dedup.duplicate_lines(docs).collect()} == want and len(want) > 20


@pytest.mark.parametrize("letters,shares", [("ab", 1), ("abcdefghijklmnop ", 3), ("日本語漢字é ", 2)])
def test_line_pairs_are_all_pairs(letters, shares):
    """The search alone, in one share of the hashes or several, gives every pair that all pairs give."""
    rng = random.Random(13)
    forms = []
    for n in (10, 12, 20, 21, 30, 39, 40, 64, 100, 181, 260):
        for _ in range(3):
            s = "".join(rng.choice(letters) for _ in range(n))
            forms += [s, *("".join(x if rng.random() > 0.05 else rng.choice(letters) * rng.randint(0, 2) for x in s) for _ in range(4))]
    forms = list(dict.fromkeys(f for f in forms if len(f.encode()) >= 20))
    i, j = np.triu_indices(len(forms), 1)
    near = edits.Texts(forms).similar(i, j, 0.9)
    want = set(zip((i[near] + 1).tolist(), (j[near] + 1).tolist()))
    h = pa.array(range(1, len(forms) + 1), pa.int64())
    stored = list(line_pairs.store(iter([pa.RecordBatch.from_arrays([h, pa.nulls(len(h), pa.int64()), pa.array(forms)], ["h", "label", "text"])])))
    bands = {b for x in stored for b in x["band"].to_pylist()}
    got = set()
    for b in bands:
        for share in range(shares):
            rows = list(line_pairs.emit(0.9, b, b, share, shares, 3)(iter(stored)))
            for x in line_pairs.meet(0.9)(iter(pa.Table.from_batches(rows).sort_by("part").to_batches())) if rows else ():
                got |= set(zip(x["a"].to_pylist(), x["b"].to_pylist()))
    assert want <= got and len(want) > 30


def test_line_dedup_verifies_bounded_pieces(spark, monkeypatch):
    """What is compared at once is bounded in bytes, however many parts, pairs or long lines a batch has."""
    taken = []

    class Counted(edits.Texts):
        def __init__(self, texts):
            taken.append(sum(map(len, texts)))
            super().__init__(texts)

    monkeypatch.setattr(line_dedup, "Texts", Counted)
    monkeypatch.setattr(edits, "Texts", Counted)
    monkeypatch.setattr(line_dedup, "COMPARED", 4000)
    rng = random.Random(16)
    text = [s + end for s in ("".join(rng.choice("abcdefg ") for _ in range(500)) for _ in range(40)) for end in "01"]
    form = pa.array([b"%016d" % k for k in range(80)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([k // 4 for k in range(80)]), form, pa.array(text)], ["part", "form", "text"])
    got = pa.Table.from_batches(line_dedup._verify_parts(0.9)(iter([batch])))
    assert {(x["a"], x["b"]) for x in got.to_pylist()} == {(b"%016d" % k, b"%016d" % (k + 1)) for k in range(0, 80, 2)}
    pairs = pa.RecordBatch.from_arrays([form[::2], pa.array(text[::2]), form[1::2], pa.array(text[1::2])], ["a", "x", "b", "y"])
    assert sum(b.num_rows for b in line_dedup._verify_pairs(0.9)(iter([pairs]))) == 40
    assert max(taken) < 6000 and len(taken) > 20


def test_line_pairs_list_no_pair_of_one_label_and_no_place_twice(monkeypatch):
    """Lines of one label and a phrase that two lines repeat cost no more than the lines; pairs of other labels are all found."""
    rng = np.random.default_rng(15)
    key, among = (rng.integers(0, 12, n).astype(np.uint64) for n in (300, 200))
    label, label2 = (rng.integers(0, 5, n).astype(np.uint64) for n in (300, 200))
    got = [x for i, j in line_pairs._found(key, among, label, label2) for x in zip(i.tolist(), j.tolist())]
    assert sorted(got) == [(i, j) for i in range(300) for j in range(200) if key[i] == among[j] and label[i] != label2[j]]
    listed, plain = [], line_pairs._found
    monkeypatch.setattr(line_pairs, "_found", lambda *a: ((listed.append(len(i)), (i, j))[1] for i, j in plain(*a)))
    texts = ["the same words again " * 200 + "and one end", "the same words again " * 200 + "or another end"]
    stored = list(line_pairs.store(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.nulls(2, pa.int64()), pa.array(texts)], ["h", "label", "text"])])))
    band = max(b for x in stored for b in x["band"].to_pylist())
    rows = list(line_pairs.emit(0.9, band, band, 0, 1, 2)(iter(stored)))
    found = {(a, b) for x in line_pairs.meet(0.9)(iter(pa.Table.from_batches(rows).sort_by("part").to_batches())) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())}
    assert found == {(1, 2)} and sum(listed) < 10_000


@pytest.mark.parametrize("shares", [1, 3])
def test_line_pairs_shuffle_only_what_may_meet(shares):
    """With a sieve of the longer lines' halves few n-grams go out, a line's own halves let none of them pass, and every similar pair is still found."""
    rng = random.Random(18)
    forms = []
    for n in (60, 120, 250, 300, 320, 700):
        for k in range(40):
            s = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
            forms += [s, *([_edited(rng, s, n // 12)] if k < 3 else [])]
    forms = list(dict.fromkeys(forms))
    i, j = np.triu_indices(len(forms), 1)
    near = edits.Texts(forms).similar(i, j, 0.9)
    want = set(zip((i[near] + 1).tolist(), (j[near] + 1).tolist()))
    stored = list(line_pairs.store(iter([pa.RecordBatch.from_arrays([pa.array(range(1, len(forms) + 1), pa.int64()), pa.nulls(len(forms), pa.int64()), pa.array(forms)], ["h", "label", "text"])])))
    bands = [b for x in stored for b in x["band"].to_pylist()]
    first, last = min(bands), max(bands)
    whole, grams, got = 0, 0, set()
    for share in range(shares):
        spots = pa.Table.from_batches(list(line_pairs.sift(0.9, first, last, share, shares, 4)(iter(stored)))).sort_by("part")
        sieve = line_pairs.sieve_of(pa.Table.from_batches(list(line_pairs.unite(4)(iter(spots.to_batches())))), 4)
        for held in (None, lambda: sieve):
            rows = pa.Table.from_batches(list(line_pairs.emit(0.9, first, last, share, shares, 2, held)(iter(stored)))).sort_by("part")
            size = sum(len(d.as_buffer()) for k, d in zip(rows["kind"].to_pylist(), rows["data"]) if k == 0)
            whole, grams = (whole, grams + size) if held else (whole + size, grams)
        for x in line_pairs.meet(0.9)(iter(rows.to_batches())):
            got |= set(zip(x["a"].to_pylist(), x["b"].to_pylist()))
    assert want <= got and len(want) >= 15 and grams < whole / 8


def test_packed_lines_write_a_label_only_where_there_is_one():
    """A packed n-gram whose line is alone in its row takes 27 bytes or so, and lines keep their labels."""
    n = 1000
    name, size = np.arange(n, dtype=np.uint64) + 7, np.arange(n) % 300 + 20
    for label in (name, np.where(np.arange(n) % 50 == 3, np.uint64(1 << 60), name)):
        h, place = line_pairs.gram_hash(np.arange(n, dtype=np.uint32), 1), np.arange(n) % 20
        beside = [(h >> np.uint32(k)).astype(np.uint16) for k in range(4)]
        batches = list(line_pairs._packed(0, h, 3, np.arange(n), place, beside, name, label, size))
        got = line_pairs._unpacked([x for b in batches for x in b.column("data")], 4)
        line = got[4]
        rows = sorted(zip(*[c[line].tolist() for c in got[:3]], *[c.tolist() for c in (got[3], *got[5:])]))
        assert rows == sorted(zip(*[c.tolist() for c in (name, label, size, h, place, *beside)]))
        assert sum(len(x.as_buffer()) for b in batches for x in b.column("data")) < 27 * n


def test_gram_hashes_are_of_the_characters_alone():
    """Equal n characters have equal hashes wherever they stand, in blocks of the text or at its ends; others differ."""
    text = np.random.default_rng(12).integers(97, 100, 40_000).astype(np.uint32)
    for n in range(10):
        h = line_pairs.gram_hash(text, n)
        rows = np.lib.stride_tricks.sliding_window_view(text, n) if n else np.zeros((40_001, 1), np.uint32)
        known, own = np.unique(rows, axis=0, return_inverse=True)
        assert len(h) == len(rows) and len(np.unique(h)) == len(known) == len(np.unique(np.stack((h, own.ravel()), 1), axis=0))


def test_pairs_that_share_few_grams_are_not_aligned(monkeypatch):
    """Candidates that differ leave before an alignment, and none of those within the edits allowed does."""
    rng = np.random.default_rng(11)
    parts = ["th", "er", "in", "tion", "an", "ed", "\u00e9", "ou", "\U0001f600"]
    line = lambda n: " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n))
    seen, plain = [], edits.aligned
    monkeypatch.setattr(edits, "aligned", lambda *a: (seen.append(1), plain(*a))[1])
    a, b = [line(100) for _ in range(100)], [line(100) for _ in range(100)]
    assert not edits.similar_pairs(a, b, 0.9).any() and len(seen) < 10
    a = [line(int(rng.integers(2, 60))) for _ in range(600)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(rng.integers(0, max(2, len(x) // 4))):
            k = int(rng.integers(len(y)))
            y[k : k + int(rng.integers(2))] = ["z"] * int(rng.integers(2))
        b.append("".join(y))
    want = [1 - edits.distance(x, y) / max(len(x), len(y)) >= 0.9 - 1e-9 for x, y in zip(a, b)]
    assert edits.similar_pairs(a, b, 0.9).tolist() == want and 100 < sum(want) < 500
    n = np.arange(600)
    assert edits.Texts([*a, *b]).similar(n, n + 600, 0.9).tolist() == want
