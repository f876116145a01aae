"""The operators on small inputs with nulls, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, line_dedup, near_dedup, suffix_dedup, toxicity
from glossa.llm import sentencepiece_codec as codec

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, key string, row string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "r", 1) for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


BASE = words(1, 60)
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " zz"), (4, None), (5, ""), (6, "   "), (7, "one two"), (8, "One two"), (9, words(2, 40)), (10, words(3, 30) + " " + BASE),
    (None, BASE), (11, "été 日本 \U0001F600 " * 30), (12, "x" * 3000), (13, words(2, 40) + "\n" + words(4, 5)), (14, "Idiot " + words(5, 10)),
]


def test_exact_groups(spark):
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(docs(spark, ROWS)).collect()), key=str)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in ROWS:
        g = groups[t or ""]
        best = max((x for x in g if x is not None), default=None)
        want.append((i, best, len(g), i == best))
    assert got == sorted(want, key=str)
    kept = exact_dedup.exact_dedup(docs(spark, ROWS))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(x for x in g if x is not None) for g in groups.values())
    assert exact_dedup.exact_groups(docs(spark, ROWS).limit(0)).count() == 0
    small = exact_dedup.exact_groups(docs(spark, ROWS), keep="smallest").where("group_size = 4").first()
    assert small["keep_id"] == 1


def brute_windows(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(item)
        found.discard(None)
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_windows", [1 << 18, 40])
def test_decontamination(spark, max_windows):
    items = [(1, " ".join(BASE.split()[5:25])), (2, "ONE, two!"), (3, None), (4, ""), (None, words(2, 12)), (11, " ".join(BASE.split()[20:40])), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs(spark, ROWS), bench, max_windows=max_windows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_windows(ROWS, items)))
    clean = decontaminate.decontaminate(docs(spark, ROWS), bench, "drop", max_windows=max_windows)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in brute_windows(ROWS, items) if not r[5])
    cut = decontaminate.decontaminate(docs(spark, ROWS), bench, "spans", max_windows=max_windows)
    assert cut.count() == len(ROWS) and cut.columns == docs(spark, ROWS).columns
    assert all(x not in r["text"].lower() for r in cut.collect() for x in ("one two",) if r["text"])
    assert decontaminate.report(docs(spark, ROWS), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs(spark, ROWS).limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs(spark, ROWS), bench, "mask")


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(table).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 20")
    rows = out.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.9 * len(rows)
    odd = docs(spark, ROWS)
    got = {str(r["doc_id"]): r for r in language_id.identify(odd).collect()}
    assert got["4"]["lang_pred"] == got["5"]["lang_pred"] == got["6"]["lang_pred"] == "und" and got["4"]["score"] == 0
    assert got["7"]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values()) and len(language_id.identify(odd).collect()) == len(ROWS)
    assert language_id.identify(odd.limit(0)).count() == 0


def test_toxicity(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(table, labels)
    held = out.where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert right >= 0.9 * len(held) and sum(r["predicted"] for r in held if r["toxic"]) >= 0.6 * sum(r["toxic"] for r in held)
    model = toxicity.fit(table, labels)
    got = toxicity.score(docs(spark, ROWS), model).collect()
    assert len(got) == len(ROWS) and all(r["score"] == 0 for r in got if not (r["text"] or "").strip())
    assert toxicity.drop_toxic(docs(spark, ROWS), model).columns == docs(spark, ROWS).columns
    assert toxicity.toxicity(table.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs(spark, ROWS), toxicity.train([], np.array([]))).collect()} == {0.0}


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights().items()}
    x, mask, y = rng.standard_normal((5, 3, toxicity.INPUTS)), np.ones((5, 3)), np.array([1.0, 0.0, 1.0])
    mask[3:, 1] = 0
    loss = lambda q: float(np.mean(np.logaddexp(0, -(2 * y - 1) * toxicity.forward(q, x, mask)[0])))
    g = toxicity.gradient(p, x, mask, y, decay=0.0)
    for name in p:
        k = tuple(0 for _ in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][k] += 1e-3
        down[name][k] -= 1e-3
        assert g[name][k] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-3), name


def test_gradient_of_the_inputs():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights().items()}
    x, mask, y = rng.standard_normal((6, 2, toxicity.INPUTS)), np.ones((6, 2)), np.array([1.0, 0.0])
    mask[4:, 0] = 0
    loss = lambda v: float(np.mean(np.logaddexp(0, -(2 * y - 1) * toxicity.forward(p, v * mask[:, :, None], mask)[0])))
    g = toxicity.gradient(p, x * mask[:, :, None], mask, y, 0)["x"] * mask[:, :, None]
    for k in [(0, 0, 0), (3, 1, 5), (5, 1, 7), (5, 0, 2)]:
        up, down = x.copy(), x.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert g[k] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-4)


def test_words_look_up_their_embeddings():
    """Inputs of words, in any batch, are those of a word alone; a word's vector and the greatest of its n-grams'."""
    rng = np.random.default_rng(2)
    word, gram = (rng.standard_normal((1 << toxicity.BITS, toxicity.WORD_DIM)).astype(np.float32) for _ in range(2))
    some = ["idiot", "a", "ab", "scum", "été", "idiots"]

    def inputs(ws):
        slots = toxicity.word_slots(pa.array(ws))
        return slots, toxicity.inputs_of(slots[0], toxicity.flat_grams(slots, len(ws)), word, gram)

    _, whole = inputs(some)
    for k, w in enumerate(some):
        slots, x = inputs([w])
        assert (x[0] == whole[k]).all() and (x[0, : toxicity.WORD_DIM] == word[slots[0][0]]).all()
        grams = np.concatenate([s for _, s, _ in slots[1]])
        assert (x[0, toxicity.WORD_DIM :] == (gram[grams].max(0) if len(grams) else 0)).all()


def test_toxicity_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, 1)], "doc_id long, text string, score double, Predicted int")
    got = toxicity.score(rows, toxicity.train([], np.array([])))
    assert got.columns == ["doc_id", "text", "score", "Predicted", "_score", "_predicted"] and got.first()["score"] == 0.5


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dedup(spark):
    rng, rows = random.Random(4), list(ROWS)
    base = words(9, 80).split()
    for k in range(60):  # a group whose members are not all near each other
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w)))
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    want = [(i, len(shingles(t)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows]
    got = near_dedup.groups(docs(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = near_dedup.dedup(docs(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in want if w[3]} and kept.columns == docs(spark, rows).columns
    assert near_dedup.groups(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [suffix_dedup.MAX_BUCKET, 1])
def test_suffix_dedup(spark, bucket):
    rows = [(i, t) for i, t in ROWS] + [(20, words(6, 50) + BASE[:230] + words(7, 20)), (21, "é" * 150), (22, "ab" * 120)]
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone) if not y)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.report(docs(spark, rows), max_bucket=bucket)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert suffix_dedup.report(docs(spark, rows).limit(0)).count() == 0
    assert suffix_dedup.dedup(docs(spark, rows), max_bucket=bucket).count() == len(rows)


def test_line_dedup(spark):
    long = "a line of more than twenty characters"
    rows = [(1, f"{long}\nshort\n"), (2, f" {long}x\nshorT\nshort"), (3, f"{long[:5]}{long[6:]}\n{long}"), (4, None), (5, ""), (None, long), (6, long[:10] + "Q" + long[11:] + "\nother")]
    got = {r["doc_id"]: (r["n_lines"], list(r["dropped"])) for r in line_dedup.report(docs(spark, rows)).collect()}
    assert got == {1: (3, []), 2: (3, [0, 1, 2]), 3: (2, [0, 1]), 4: (1, []), 5: (1, []), None: (1, [0]), 6: (2, [0])}
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert text[2] == "" and text[4] is None and text[6] == "other" and text[3] == ""
    assert line_dedup.report(docs(spark, rows).limit(0)).count() == 0


def test_chat_format(spark):
    calls = spark.createDataFrame([
        ("c", "b", 2, "add", '{"y": 2, "x": 1}', ["a"]), ("c", "a", 3, "add", '{"x": "1", "z": 0}', ["zz"]), ("c", "e", 1, "no", "[]", None), ("c", "f", 9, "no", '{}', ["f"]),
        ("d", "a", 1, "add", None, None), ("d", None, 1, "add", "{}", None), ("c", "b", 5, "add", "{}", None),
    ], "conv_id string, call_id string, turn long, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([("c", "a", 'say "hi"'), ("c", "a", "z"), ("c", "q", "lost"), ("x", "a", None)], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "integer", True, 0.0, 1.0), ("add", "y", "number", False, None, 1.5)], "tool string, field string, type string, required boolean, minimum double, maximum double")
    got = {r["conv_id"]: r for r in chat_format.link_tools(calls, results, schemas).collect()}
    c = got["c"]
    assert (c["n_calls"], c["n_linked"], c["n_orphans"], c["n_invalid"], c["n_cyclic"]) == (4, 1, 1, 4, 1)
    order = re.findall(r'"id":"(\w)"', c["json"])
    assert order == ["e", "a", "b", "f"]
    assert '{"arguments":{"x":1,"y":2},"errors":["range:y"],"id":"b","name":"add","result":null}' in c["json"]
    assert '"errors":["type:x","unknown:z"]' in c["json"] and '"result":"say \\"hi\\""' in c["json"]
    assert got["d"]["n_invalid"] == 1 and got["x"]["n_orphans"] == 1 and got["x"]["json"] == '{"calls":[]}'
    assert chat_format.link_tools(calls.limit(0), results.limit(0), schemas).count() == 0


def test_html(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        "<article><h1>A  title &amp; more</h1><p>First <b>bold</b>\n words of the story, which goes on.<p>Second&nbsp;part of it, with more to say.</article>"
        "<section id='comments'><p>I like it.</p></section><footer><p>&copy; someone</p></footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "u", page, 3), (1, None, None, 3), (None, "v", "", 3), (2, "w", "<p", 3)], "page_id long, url string, html string, n_chars int")
    got = [tuple(r) for r in html_extract.extract(rows).collect()]
    text = "A title & more\nFirst bold words of the story, which goes on.\nSecond part of it, with more to say."
    assert (1, "u", text, len(text)) in got and (1, None, "", 0) in got and (None, "v", "", 0) in got and len(got) == 4
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_decoding_is_consistent():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        label = html_extract.decode(parent, [True] * n, rng.standard_normal(n) * 3, rng.standard_normal(n) * 3)
        for k in range(1, n):
            up = label[parent[k]]
            assert not (up == 2 and label[k] != 2) and not (up == 1 and label[k] == 0)


def test_sentencepiece(spark):
    import sentencepiece

    model, lib = codec.load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*ROWS, (30, " a  b\n c\n\nd "), (31, "x" * 500 + "▁y\tq"), (32, "日本語\x00z"), (33, "\n"), (34, "internationalization" * 30)]
    out = codec.encode(docs(spark, rows), model)
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["round_trip"]) for r in out.collect())
    assert got == sorted((str(i), lib.encode(t or ""), True) for i, t in rows)
    back = {str(r["doc_id"]): r["text"] for r in codec.decode(out, model).collect()}
    assert all(back[str(i)] == (t or "").replace("▁", " ") for i, t in rows if i not in (2,))
    assert codec.encode(docs(spark, rows).limit(0), model).count() == 0
    blocks = codec.encode(docs(spark, rows), model, block_words=20)
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["round_trip"]) for r in blocks.collect()) == got


def test_unigram_viterbi(spark):
    pieces = [("", 0.0), ("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -4.5), ("bb", -3.5), *[(bytes([k]), 0.0) for k in range(256)]]
    model = codec.Model("unigram", tuple(pieces), 0)
    score = {p: s for p, s in pieces if isinstance(p, str) and p}

    def best(w):
        table = [(0.0, [])]
        for e in range(1, len(w) + 1):
            options = [(table[s][0] + score.get(w[s:e], -14.5 if e - s == 1 else -1e9), table[s][1] + [w[s:e]]) for s in range(e)]
            table.append(max(options, key=lambda x: x[0]))
        return table[-1][1]

    ids = {p: k for k, (p, _) in enumerate(pieces) if isinstance(p, str) and p}
    texts = ["abbab", "bbb a", "axb", "abab abb"]
    got = {r["doc_id"]: list(r["ids"]) for r in codec.encode(docs(spark, list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        want = []
        for w in codec.WORD.findall(" " + t):
            for symbol in best(w.replace(" ", "▁")):
                want += [ids[symbol]] if symbol in ids else [model.bytes_ids[b] for b in symbol.encode()]
        assert got[k] == want


def test_merge_long_equals_the_library():
    import sentencepiece

    model, lib = codec.load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    score = {p: s for p, _, s in model.normal}
    for k in range(50):
        word = words(k, 8).replace(" ", "")
        assert [w for w in codec.merge_long("▁" + word, score)] == [p for p in lib.encode(word, out_type=str) if p]


def test_varints():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1])
    assert (codec.unpack(codec.pack(numbers)) == numbers).all() and len(codec.unpack(codec.pack(np.empty(0, np.int64)))) == 0
    assert pa.__version__


def test_bpe_models_with_late_pieces(spark):
    """Random models whose pieces' parts may be worse than they are: the fold equals merging one by one."""
    rng = random.Random(3)
    for _ in range(2):
        pieces = {c: -100.0 for c in "▁abc"}
        while len(pieces) < 40:
            p = "".join(rng.choice("▁abc") for _ in range(rng.randint(2, 5)))
            if "▁" not in p[1:]:
                pieces.setdefault(p, -float(rng.randint(1, 30)))
        model = codec.Model("bpe", (("", 0.0), *pieces.items(), *[(bytes([k]), 0.0) for k in range(256)]), 0)
        assert codec.late_pieces(model)
        texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(20)) for _ in range(20)]
        ids = {p: k for k, (p, _) in enumerate(model.pieces) if isinstance(p, str) and p}
        got = {r["doc_id"]: list(r["ids"]) for r in codec.encode(docs(spark, list(enumerate(texts))), model).collect()}
        for k, t in enumerate(texts):
            want = []
            for w in codec.WORD.findall(" " + t):
                for symbol in codec.merge_long(w.replace(" ", "▁"), pieces):
                    want += [ids[symbol]] if symbol in ids else [model.bytes_ids[b] for b in symbol.encode()]
            assert got[k] == want


def test_ids_equal_the_library(spark):
    import sentencepiece

    model, lib = codec.load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: lib.encode(r["text"] or "") for r in table.collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in codec.encode(table, model).collect()}
    assert got == want


def test_benchmark_blocks_hold_real_windows():
    """A long item of joined words is split, and no block has more windows than it may."""
    class Table:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            yield from [("a", ".".join(f"w{k}" for k in range(500))), ("b", None), ("c", "one two"), ("d", "x " * 30)]

    blocks = list(decontaminate._blocks(Table(), 10, 100))
    sizes = [sum(len(by_hash) for by_hash, _ in decontaminate.windows_of(b, 10).values()) for b in blocks]
    assert max(sizes) <= 100 and len(blocks) == 6
    all_at_once = decontaminate.windows_of([x for b in blocks for x in b], 10)
    assert len(all_at_once[10][1]) == 491 + 1 and set(all_at_once[2][1]) == {b"one two"}


@pytest.mark.parametrize("max_windows", [1 << 18, 7])
def test_spans_are_those_of_the_text_as_it_came(spark, max_windows):
    """Overlapping passages of items in different blocks all go, as does nothing that only meets after a cut."""
    w = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w[:15])), (2, " ".join(w[10:25])), (3, "k1 k2")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "a " + " ".join(w) + " z", 1, 2), (2, "k1 " + " ".join(w[:15]) + " k2", 1, 2), (3, None, 1, 2)], "doc_id long, text string, at int, row int")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(rows, bench, "spans", max_windows=max_windows).collect()}
    assert got == {1: "a  " + " ".join(w[25:]) + " z", 2: "k1  k2", 3: None}
    kept = decontaminate.decontaminate(rows, bench, max_windows=max_windows)
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_language_equals_brute_force(spark):
    """Naive Bayes by plain counts of n-gram strings; marks alone have no letter."""
    import math
    import zlib

    texts = {"en": "the cat and the dog on the hill", "de": "der Hund und die Katze \u00fcber", "fr": "le chat et le chien sur l'\u00e9tang"}
    rows = [(k, f"{v} {k % 5}" if k % 3 else v.split()[k % 6], lang) for k, (lang, v) in enumerate(list(texts.items()) * 12)]
    rows += [(100, "\u0301\u0302", "en"), (101, "12 !", "de"), (102, None, "fr"), (103, "hund", None), (104, "e\u0301t", None)]
    counts, n_rows = {}, Counter()

    def grams(text):
        out = Counter()
        for w in re.findall("(?:[^\\W\\d_]|[\u0300-\u036f])+", (text or "").lower()):
            if any(c.isalpha() for c in w):
                for n in language_id.ORDERS:
                    for i in range(len(w) + 3 - n):
                        g = f" {w} "[i : i + n]
                        if g != " ":
                            out[g] += 1
        return out

    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2 and grams(t):
            counts.setdefault(lang, Counter()).update(grams(t))
            n_rows[lang] += 1
    slots, s = 1 << language_id.BITS, language_id.SMOOTHING
    table = spark.createDataFrame([(i, t, lang, 0) for i, t, lang in rows], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(table).collect()}
    for i, t, _ in rows:
        if not grams(t):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        logs = {k: math.log((n_rows[k] + 1) / sum(v + 1 for v in n_rows.values())) + sum(n * math.log((c[g] + s) / (sum(c.values()) + s * slots)) for g, n in grams(t).items()) for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=2e-3)
    clash = language_id.predict(table.select("doc_id", "text", "score"), language_id.fit(table))
    assert clash.columns == ["doc_id", "score", "lang_pred", "_score"]
