import math
import random
import re
from collections import Counter, defaultdict

import pytest

from rolefit.llm import quality_rules as Q

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "char_distance", "word_distance")


def klass(c):
    tests = (("space", " \t\n\v\f\r"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("mark", ".,;:!?"), ("symbol", "#*$%&|<>"))
    return next((n for n, own in tests if c in own), "other_ascii" if c < "\x80" else "to_u07ff" if c <= "\u07ff" else "from_u0800")


def bare(word):
    low = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in low)


def js(p, q):
    """Jensen-Shannon distance of two dicts of shares."""
    total = 0.0
    for k in p.keys() | q.keys():
        m = (p.get(k, 0) + q.get(k, 0)) / 2
        total += sum(x.get(k, 0) * math.log2(x[k] / m) / 2 for x in (p, q) if x.get(k, 0))
    return math.sqrt(max(0, total))


def shares(counts):
    n = sum(counts.values())
    return {k: v / n for k, v in counts.items()}


def brute(rows, rules):
    """Every row's figures by the definitions, with dicts and lists."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    chars = [Counter(map(klass, t or "")) for _, t, _ in rows]

    def refs(take):
        words, classes = defaultdict(Counter), defaultdict(Counter)
        for k in take:
            if rows[k][2] is not None:
                words[rows[k][2]].update(map(bare, split[k]))
                classes[rows[k][2]].update(chars[k])
        out = {}
        for lang, own in words.items():
            if sum(own.values()) >= rules.reference_words:
                top = dict(sorted(((w, n) for w, n in own.items() if w), key=lambda x: (-x[1], x[0].encode()))[: rules.common_words])
                out[lang] = (shares(classes[lang]), shares(top | {None: sum(own.values()) - sum(top.values())}), top)
        return out

    def far(k, near):
        out = {}
        for lang, (classes, words, top) in sorted(near.items()):
            own = Counter(w if w in top else None for w in map(bare, split[k]))
            out[lang] = (js(shares(chars[k]), classes) if sum(chars[k].values()) >= rules.least_chars else None, js(shares(own), words) if len(split[k]) >= rules.least_words else None)
        return out

    def fits(k, found, loose=1):
        allowed = math.sqrt(rules.word_distance**2 + rules.sampling * rules.common_words / (8 * math.log(2) * max(1, len(split[k]))))
        return not found or any((c is None or c <= loose * rules.char_distance) and (w is None or w <= loose * allowed) for c, w in found.values())

    first = refs(range(len(rows)))
    near = refs([k for k in range(len(rows)) if first and fits(k, far(k, first), rules.loose)])
    for k, (doc, text, _) in enumerate(rows):
        words, text = split[k], text or ""
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {i for i, w in enumerate(windows) if windows.count(w) > 1}
        repeats = len({i + d for i in again for d in range(3)})
        seen, lines = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        found = far(k, near)
        found = found if found and next(iter(found.values())) != (None, None) else {}
        best = min(found, key=lambda x: round(sum(d for d in found[x] if d is not None), 9)) if found else None
        rounded = tuple(None if d is None else round(d, 4) for d in found[best]) if found else (None, None)
        yield doc, (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, repeats, failed, fits(k, found) and not failed, best, *rounded)


def texts():
    r = random.Random(3)
    words = {"en": "the of and to in it is was for with cat dog House tree".split(), "fr": "le la et où à que été dans chat Maison l'eau élan".split(), "xx": ["日本", "の", "語。"]}
    rows = [(0, None, "en"), (1, "", "en"), (2, " \n\t", None), (3, "one", None), (4, "a\na\n a\n\n\nb b b b", "en"), (5, "Und " * 300, "fr"), (6, "x\x1cy z\xa0w " * 60, "en")]
    for k in range(7, 90):
        lang = r.choice(["en", "en", "fr", "xx"])
        own = [r.choice(words[lang]) for _ in range(r.randrange(5, 300))]
        kind = k % 6
        text = " ".join(w.upper() + "!!" if kind == 0 else w + "***" if kind == 1 else w for w in own)
        rows.append((k, text + ("\nsame line\nsame line" if k % 5 == 0 else ""), r.choice([lang, lang, lang, "fr", None])))
    return rows + [rows[20], (None, "the cat is " * 40, "en"), (200, " ".join(r.choice(words["en"]) for _ in range(20_000)), "en")]


@pytest.mark.parametrize("rules", [Q.Rules(common_words=8), Q.Rules(common_words=8, reference_words=10**7), Q.Rules(common_words=5, reference_words=300)])
def test_rules_equal_brute_force(spark, monkeypatch, rules):
    monkeypatch.setattr(Q, "FLUSH_WORDS", 5)
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, lang string, item string, kept boolean, n int").repartition(4)
    got = Q.quality_rules(docs, rules)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(((r.doc_id, tuple(r)[1:]) for r in got.collect()), key=str) == sorted(brute(rows, rules), key=str)


def test_empty_table_and_planted_junk(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert Q.quality_rules(docs.limit(0)).collect() == []
    r = random.Random(9)
    vocabulary = [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{x}" for _ in range(5) for x in ("", "n", "ring", "tion", "le", "st", "lf", "rm")]
    clean = [(k, ". ".join(" ".join(r.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(r.randrange(8, 40))) + ".", "en") for k in range(100)]
    junk = [(k, clean[k][1].upper().replace(" ", "!! ") if k % 2 else clean[k][1].replace(" ", "### "), "en") for k in range(20)]
    got = Q.quality_rules(spark.createDataFrame(clean + [(1000 + k, t, lang) for k, t, lang in junk], docs.schema)).collect()
    assert {x.doc_id for x in got if not x.kept} == {1000 + k for k in range(20)}
