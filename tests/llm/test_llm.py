import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rolefit.llm import decontaminate as D
from rolefit.llm import html_text as T
from rolefit.llm import warc
from rolefit.llm.embedding_dedup import embedding_links
from rolefit.llm.graph import connected_components
from rolefit.llm.line_dedup import line_duplicates, without_repeated_lines
from rolefit.llm.near_dedup import near_duplicates
from rolefit.llm.packing import best_fit_plan, pack
from rolefit.llm.quality import classify, keep_good
from rolefit.llm.substring_dedup import without_repeated_spans
from rolefit.llm.token_files import TokenFileReader, TokenFileWriter, read_token_files, token_round_trip, write_token_files
from rolefit.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names clash with those that the operators make.
DOCS = "doc_id long, text string, size string, n string, bands string, component string, n_chars long"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "s", "n", "b", "c", len(t or "")) if not isinstance(t, tuple) else (*t, "s", "n", "b", "c", 0) for k, t in enumerate(texts)], schema).repartition(3)


def words(n, seed, vocabulary=500):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


def mutated(base, every, seed):
    r, out = random.Random(seed), list(base)
    for k in range(every, len(out), every):
        out[k] = f"m{r.randrange(10**6)}"
    return out


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (5, 5)], "a long, b long")
    got = dict(connected_components(chain).collect())
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}
    assert connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr("rolefit.llm.near_dedup.STAR_ROUNDS", rounds)
    texts = [None, "", " \n ", "one", "One", "a b c", "a b  c d e f"]
    for g in range(6):
        base = words(40 + 30 * g, g)
        texts += [" ".join(mutated(base, every, 100 * g + k)) for k, every in enumerate((10**6, 10**6, 17, 23, 29, 50, 61, 97))]
    texts.append(" ".join(words(20_000, 99)))
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one")]
    got = sorted((tuple(r) for r in near_duplicates(docs(spark, [(i, t) for i, t in rows]), size=4).collect()), key=str)

    def shingles(t):
        ws = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    want = [(i, len(sets[i]), label[i], label[i] == i) for i, _ in rows if i is not None] + [(None, 1, None, False)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_quality(spark):
    good = [" ".join(words(30, k)) for k in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in words(30, 200 + k)) for k in range(80)]
    rows = docs(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(k, int(k < 80), None) for k in range(160)] + [(5, None, None), (None, 1, None)], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in classify(rows, labels).collect()}
    assert len(got) == 162 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [r for k, r in got.items() if r.held_out and k < 160]
    assert np.mean([r.predicted == int(r.doc_id < 80) for r in held]) >= 0.95
    assert {r.doc_id for r in keep_good(rows, labels).collect()} == {k for k, r in got.items() if r.predicted}
    assert classify(rows, labels.limit(0)).count() == 162 and classify(rows.limit(0), labels).count() == 0


def test_wand_finds_all_above_the_threshold():
    items = [(k, " ".join(words(20, k, 60))) for k in range(120)]
    n = [set(D._words(t).tolist()) for _, t in items]
    frequency = {w: sum(w in s for s in n) for s in n for w in s}
    index = D.build_index(items, frequency, 120, 20.0, 0.5)
    for seed in range(40):
        terms = np.unique(np.searchsorted(index.terms, D._words(" ".join(words(25, 500 + seed, 60)))))
        terms = terms[terms < len(index.terms)]
        total = np.zeros(120)
        for t in terms:
            np.add.at(total, index.items[index.bounds[t] : index.bounds[t + 1]], index.impacts[index.bounds[t] : index.bounds[t + 1]])
        for threshold in (0.3, 0.5):
            assert {i for i, _ in D.wand(index, terms, threshold)} == set(np.flatnonzero(total >= threshold).tolist())


def test_contamination(spark):
    items = [f"{' '.join(words(30, k, 5000))}. {' '.join(words(8, 900 + k, 5000))}." for k in range(30)]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    filler = lambda n, s: " ".join(words(n, s, 4000))
    texts = [filler(400, 1) + " " + items[3] + " " + filler(300, 2), items[7].upper(), filler(900, 3), None, "", items[4][: len(items[4]) // 2], filler(5000, 5) + items[9], items[2] + items[11]]
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs(spark, texts), benchmark).collect()}
    assert got == {(0, 3), (1, 7), (6, 9), (7, 2), (7, 11)}
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs(spark, texts), benchmark, slice_items=7).collect()} == got
    assert D.contamination(docs(spark, texts), benchmark.limit(0)).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(1)
    letters = "abzABZ.,;'!<|>éßΣσς́  \n\t\x85\x1c12İ中🎉startofendtext&*#"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>b, <|ENDOFTEXT|>!", "it's we'll, x.'s"]
    ids, bounds = own.encode([t.encode() for t in texts])
    assert all(library.encode(t, add_special_tokens=False).ids == ids[a:b].tolist() for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True))


def test_packing(spark):
    r = random.Random(4)
    sizes = [r.choice((4096, r.randint(1, 4096), r.randint(1, 300))) for _ in range(3000)]
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    rest = []
    for s in sorted(sizes, reverse=True):
        fit = min((x for x in rest if x >= s), default=None)
        if fit is not None:
            rest.remove(fit)
        rest.append((4096 if fit is None else fit) - s)
    plan, used, room = best_fit_plan(counts, 4096), set(), {}
    for step in plan:
        ranks = sorted(x.rank for x in plan if x.size == step.size and x.rank > step.rank)
        pieces = (ranks[0] if ranks else counts[step.size]) - step.rank
        for k in range(pieces):
            own = step.first_bin + k // step.each
            used.add(own)
            room[own] = room.get(own, 4096) - step.size
    assert used == set(range(len(rest))) and sorted(room.values()) == sorted(rest)  # as many bins, as full, as one piece after the other gives
    assert len(best_fit_plan({}, 4096)) == 0
    texts = [" ".join(words(r.randint(0, 60), k)) for k in range(60)] + [None, "", " ".join(words(900, 3))]
    rows = pack(docs(spark, texts), PATH, capacity=200).collect()
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 200
    own = WordEncoder(PATH)
    for k, t in enumerate(texts):
        ids = [*own.encode([(t or "").encode()])[0].tolist(), 1]
        got = sorted((x.piece, x.start, x.length, x.ids_crc32) for x in rows if x.doc_id == k)
        assert got == [(p, a, len(ids[a : a + 200]), zlib.crc32(np.array(ids[a : a + 200], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 200))]
    assert pack(docs(spark, texts).limit(0), PATH).count() == 0


def test_token_files(spark, tmp_path):
    import pyarrow.fs as pafs

    store, path = pafs.LocalFileSystem(), str(tmp_path / "x.tok")
    ids = [np.arange(k * 10, dtype="<u4") for k in range(50)]
    with store.open_output_stream(path) as sink:
        out = TokenFileWriter(sink, frame_ids=700)
        for k, x in enumerate(ids):
            out.add(k if k else None, x)
        out.close()
    with store.open_input_file(path) as source:
        file = TokenFileReader(source)
        assert len(file.frames) > 10
        assert [(d, x.tolist()) for d, x in file.read(13, 31)] == [(k, ids[k].tolist()) for k in range(13, 31)]
    raw = bytearray(open(path, "rb").read())
    raw[5] ^= 1
    open(path, "wb").write(raw)
    with store.open_input_file(path) as source, pytest.raises(ValueError, match="damaged"):
        TokenFileReader(source).frame(0)
    texts = ["b c", None, "", "a " * 500, "b c"]
    own, at = WordEncoder(PATH), 0
    got = sorted(tuple(r) for r in token_round_trip(docs(spark, texts), PATH).collect())
    for k, t in enumerate(texts):
        x = np.append(own.encode([(t or "").encode()])[0], 1).astype("<u4")
        assert got[k] == (k, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    files = write_token_files(docs(spark, texts), f"file://{tmp_path}/t", PATH)
    assert sorted(tuple(r) for r in read_token_files(files, f"file://{tmp_path}/t", docs_a_task=1).collect()) == got
    assert token_round_trip(docs(spark, texts).limit(0), PATH).count() == 0


def test_repeated_spans_equal_brute_force(spark):
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefghé ") for _ in range(n))
    passage, other = noise(700), noise(260)
    texts = [noise(900) + passage + noise(50), passage[100:] + noise(300), noise(200) + passage[:350] + noise(10) + passage[350:] + other, other, other, None, "", "ab" * 400, noise(50), "x" * 199, "x" * 201, passage * 3]
    texts += [noise(30) + passage[k % 7 : 400 + k] + noise(30) for k in range(25)]
    seen, starts = {}, []
    for k, t in enumerate(texts):
        data = (t or "").encode()
        for s in range(len(data) - 199):
            seen[data[s : s + 200]] = seen.get(data[s : s + 200], 0) + 1
            starts.append((k, s, data[s : s + 200]))
    cover = {k: bytearray(len((t or "").encode())) for k, t in enumerate(texts)}
    for k, s, x in starts:
        if seen[x] > 1:
            cover[k][s : s + 200] = b"\1" * 200
    got = {x.doc_id: x for x in without_repeated_spans(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        data, c = (t or "").encode(), cover[k]
        runs = sum(1 for i in range(len(c)) if c[i] and (not i or not c[i - 1]))
        kept = bytes(b for b, x in zip(data, c, strict=True) if not x)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(data), sum(c), runs, hashlib.sha256(kept).hexdigest())
    assert without_repeated_spans(docs(spark, texts).limit(0)).count() == 0


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    rows = [base[k % 60] + (0.12 * r.normal(size=16) if k >= 60 else 0) for k in range(300)] + [base[0]] * 3
    vectors = [(k, x.astype(np.float32).tolist(), "x") for k, x in enumerate(rows)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None] * 16, "x"), (904, [1.0, 2.0], "x"), (905, [], "x"), (None, rows[0].tolist(), "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, size string")
    got = {x.vec_id: x for x in embedding_links(frame, block_rows=16).collect()}
    m = np.array([v[1] for v in vectors[: len(rows)]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    assert len(got) == len(vectors) and sum(x.n_links for x in got.values()) >= 0.95 * near.sum() > 0
    assert all(got[k].n_links <= near[k].sum() for k in range(len(rows)))
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 906)) and got[None].n_links == 0
    assert got[300].component_id == 0 and not got[300].kept and got[0].kept
    assert embedding_links(frame.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [1, 32])
def test_line_duplicates_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr("rolefit.llm.line_dedup.LISTED_LINES", listed)
    r = random.Random(5)
    lines = [" ".join(words(8, k)) for k in range(40)]

    def edited(s, n):
        for _ in range(n):
            p = r.randrange(len(s))
            s = r.choice((s[:p] + "é" + s[p:], s[:p] + s[p + 1 :], s[:p] + "Q" + s[p + 1 :]))
        return s

    texts = ["\n".join([r.choice(("short", "", r.choice(lines), edited(r.choice(lines), r.randint(0, 4)), "  " + r.choice(lines) + " \r")) for _ in range(6)]) for _ in range(40)] + [None, "", "\n\n", lines[0]]
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no, x.n_links, x.kept) for x in line_duplicates(docs(spark, texts)).collect()}

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    spots = [((k, n), s.strip(" \t\r")) for k, t in enumerate(texts) for n, s in enumerate((t or "").split("\n"))]
    first = {}
    for at, s in sorted(spots):
        first.setdefault(s, at)
    known = [s for s in first if len(s) >= 20]
    near = {s: [o for o in known if o != s and abs(len(o) - len(s)) <= 2 and distance(s, o) <= 2] for s in known}
    assert sum(map(len, near.values())) > 10
    for at, s in spots:
        want = (*first[s], len(near[s]), first[s] == at and all(first[s] < first[o] for o in near[s])) if len(s) >= 20 else (*at, 0, True)
        assert got[at] == want
    assert len(got) == len(spots)
    rest = {x.doc_id: x.text for x in without_repeated_lines(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        keep = [s for n, s in enumerate((t or "").split("\n")) if got[(k, n)][3]]
        assert rest.get(k) == ("\n".join(keep) if t is not None else None) if keep else k not in rest
    assert line_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- ad --><div class='ad'>Buy</div><article><h1>Head &amp;  line</h1><p>One <b>two</b>\n three.<br>four<p>Five &lt;6&gt;</p></article><footer>&copy; x</footer></body></html>"
    assert [b.text for b in T.blocks(page) if T.teaching_label(b)] == ["Head & line", "One two three. four", "Five <6>"]
    rows = [(k, f"u{k}", page.replace("One", f"One{k} " + " ".join(words(20, k))), "x") for k in range(60)] + [(100, None, None, "x"), (101, "u", "", "x"), (102, "u", "<p", "x"), (None, "u", page, "x"), (103, "u", page, "x"), (103, "u", page, "x")]
    got = T.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, h string")).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == len(rows) and by[100].text == by[101].text == "" and by[103].text == "Head & line\nOne two three. four\nFive <6>" and by[103].n_chars == len(by[103].text)
    assert all(by[k].text == "\n".join(b.text for b in T.blocks(rows[k][2]) if T.teaching_label(b)) for k in range(60))


def test_salvage():
    own = [warc.encode_record(k, f"http://x/{k}", b"payload %d " % k * 30) for k in range(5)]
    data = own[0] + own[1][:-40] + b"junk" + own[2] + b"WARC/1.1\r\nbroken" + own[3] + own[4][:20]
    got = list(warc.salvage(data))
    assert [x.headers["warc-record-id"] for x in got if isinstance(x, warc.Record)] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    gaps = [(x.start, x.end) for x in got if isinstance(x, warc.Gap)]
    assert len(gaps) == 3 and all(data[a:b] for a, b in gaps) and gaps[-1][1] == len(data)
    import gzip

    plain = gzip.decompress(own[0]) + b"x" + gzip.decompress(own[1])
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(plain)) == 2 and list(warc.salvage(b"")) == []


def test_archives(spark):
    big = "x" * 150
    rows = [(3, "u", big), (1, "u", big), (2, None, "small"), (4, "u\n", "small"), (5, "u", None), (6, "u", ""), (1, "u", big), (None, "u", big)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.warc_round_trip(frame).collect()), key=str)
    want = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and p != 1 else "response", 1 if h == big and p != 1 else None) for p, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    base = words(60, 1)
    rows = docs(spark, [" ".join(base), " ".join(mutated(base, 59, 2)), " ".join(words(60, 3)), None])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == {0, 2, 3}
    assert corpus_pipeline.near_dedup(spark, rows, "").columns == rows.columns
    assert rows.select(F.count("*")).first()[0] == 4
