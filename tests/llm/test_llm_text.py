"""Token counts, pieces, toxicity, licenses, quality and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import bpe, licenses, packing, pieces, quality, simhash, toxicity

POOL = ["a", "b", "é", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "'s", "'ll", "1", "²", "中", "\U0001f600", "<|endoftext|>", "the", " and", "́", "-", "...", "ß", "\xa0", "\r\n", ",", "word, ", "!", " x."]
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 50_000), (5, "same text here"), (5, "same text here"), (None, "no id"), (7, "the end. " * 3000)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def docs(spark, rows):
    """With columns whose names are those of inner and result columns."""
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, n_tokens int, score string").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_token_counts(spark, tokenizer):
    for t in [*texts(3000), "a" * 5000, "ab" * 3000]:
        assert bpe.count_tokens(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t
    rows = bpe.token_counts(docs(spark, EDGE)).collect()
    expected = Counter((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in EDGE)
    assert Counter(map(tuple, rows)) == expected
    assert bpe.token_counts(docs(spark, EDGE).limit(0)).count() == 0
    with pytest.raises(ValueError, match="results"):
        bpe.token_counts(docs(spark, EDGE), keep=["n_tokens"])


def test_token_memo_overflow(tokenizer):
    for t in texts(300, 5):
        assert bpe.count_tokens(t, entries=3) == len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_pieces(spark):
    codec = pieces.codec(pieces.default_path())
    m = codec.model
    score = {m.bytes_of[i].decode().replace(" ", pieces.MARK): s for i, s in m.score.items()}
    for key, i in ((m.bytes_of[i].replace(b" ", pieces.MARK.encode()), i) for i in list(m.score)[::97]):
        assert m.trie.prefixes(key, 0)[-1] == (len(key), i)

    def best(word):
        out = [0.0] + [-math.inf] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 40) + 1):
                s = score.get(word[i:j], m.least if j == i + 1 else None)
                if s is not None:
                    out[j] = max(out[j], out[i] + s)
        return out[-1]

    def total(ids):
        s, held = 0.0, b""
        for i in ids:
            if i in m.score:
                s += m.score[i]
                continue
            held += m.bytes_of[i]
            try:
                held.decode()
            except UnicodeDecodeError:
                continue
            s, held = s + m.least, b""
        return s

    for t in [*texts(1000, 2), "▁ x ▁▁", "ing" * 300]:
        ids = codec.encode(t)
        assert m.decode(ids) == t
        if t and pieces.MARK not in t:
            assert total(ids) == pytest.approx(best(pieces.MARK + t.replace(" ", pieces.MARK)))
    rows = pieces.digests(docs(spark, EDGE), keep=["doc_id"]).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (1, 2)} == {0}
    got = pieces.encoded(docs(spark, EDGE), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((d, t or "") for d, t in EDGE)


def test_unigram_scores_against_every_segmentation():
    # real log scores, pieces across words, byte fallback
    marked = pieces.MARK
    table = {10 + i: (p, s) for i, (p, s) in enumerate([(marked, -3.1), ("a", -2.0), ("b", -2.3), ("ab", -2.9), (marked + "a", -3.4), ("ba", -3.9), (f"b{marked}a", -4.6), (f"a{marked}", -4.2), ("é", -5.0), ("aab", -4.4)])}
    model = pieces.Unigram(table, list(range(300, 556)))
    codec = pieces.Codec(model)
    assert not model.by_word and pieces.Unigram({10: (marked + "a", -1.0)}, list(range(300, 556))).by_word
    score = {p: s for p, s in table.values()}

    def best(word):
        if not word:
            return 0.0
        options = [score[word[:k]] + best(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in score]
        return max([*options, *([model.least + best(word[1:])] if word[0] not in score else [])])

    rng = random.Random(12)
    for _ in range(150):
        t = "".join(rng.choice(["a", "b", " ", "é", "z", "€"]) for _ in range(rng.randint(0, 9)))
        ids = codec.encode(t)
        assert model.decode(ids) == t
        if t:
            runs = sum(table[i][1] for i in ids if i in table) + model.least * sum(c in "z€" for c in t)
            assert runs == pytest.approx(best(marked + t.replace(" ", marked)))


def test_inner_names_as_columns(spark):
    odd = spark.createDataFrame([(1, "some text of five words", "a", "b", "c", 4, 5), (2, None, "a", "b", "c", 4, 5)], "doc_id long, text string, __text string, __row string, __w string, __task int, __rank int")
    keep = ["doc_id", "__text", "__row", "__task", "__rank"]
    for found in (bpe.token_counts(odd, keep=keep), pieces.digests(odd, keep=keep), packing.packed(odd, keep=keep), simhash.fingerprints(odd, keep=keep), quality.judged(odd.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")), keep=keep)):
        rows = found.orderBy("doc_id").collect()
        assert [(r.doc_id, r["__text"], r["__row"], r["__task"], r["__rank"]) for r in rows] == [(1, "a", "b", 4, 5), (2, "a", "b", 4, 5)]
        assert found.columns[: len(keep)] == keep
    assert pieces.digests(odd.limit(0), keep=keep).count() == 0 and pieces.encoded(odd.limit(0), keep=keep).count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "ti", "on", "er", "st", "ou", "ble", "ing", "sh", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "IDIOT,", "ѕcum", "1d10t"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(500, 4)
    d = docs(spark, rows)
    lexicon = toxicity.learn(d, spark.createDataFrame([*labels, (10**6, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, lexicon, keep=["doc_id"]).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, r in got.items() if r.h]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.95
    edge = toxicity.score(docs(spark, EDGE), lexicon, keep=["doc_id"]).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in edge)


def test_toxicity_exceptions_and_no_labels(spark):
    lexicon = toxicity.Lexicon({" ass": 3.0, " assess ": 0.0}, (-2.0, 0.0, 0.0, 2.0, 0.0))
    assert lexicon.score("you ass") > 0.5 > lexicon.score("assess this") and lexicon.score(None) == lexicon.score("")
    assert toxicity.fold("ѕCUM 1d10t​!") == " scum idiot  "
    none = toxicity.learn(docs(spark, EDGE), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs(spark, EDGE), none, keep=["doc_id"]).collect()} == {0.5}


def test_toxicity_hits_are_those_of_a_plain_search():
    rng = random.Random(41)
    letters = "ab c"
    for _ in range(300):
        made = {" " + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["", " "]) for _ in range(6)}
        weights = {p: rng.choice([0.0, 1.0, 2.5]) if p.endswith(" ") else 1.5 for p in made} | {" a b ": 0.0, " b a ": 3.0}
        lexicon = toxicity.Lexicon(weights)
        folded = f" {''.join(rng.choice(letters) for _ in range(40))} "
        places = [(i, i + len(p), w) for p, w in weights.items() for i in range(len(folded)) if folded[i : i + len(p)] == p]
        wanted = []
        for start in range(len(folded)):
            own = [(b, w) for a, b, w in places if a == start and w]
            if own and not any(not w and a <= start and max(own)[0] <= b for a, b, w in places):
                wanted.append(max(own)[1])
        assert lexicon.hits(folded) == wanted


def test_toxicity_learns_phrases_as_exceptions(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randrange(30), "trash")
        elif i % 4 == 1:
            words[7:7] = ["recycle", "trash"] if i % 8 == 1 else ["trash", "bin"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d = docs(spark, rows + [(5, "another text of a known id")] * 3)
    lexicon = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    if " trash " in lexicon.weights or any(" trash ".startswith(p) for p in lexicon.weights):
        assert lexicon.weights.get(" recycle trash ") == 0.0 and lexicon.weights.get(" trash bin ") == 0.0
        assert lexicon.score("you are trash my friend") > 0.5 > max(lexicon.score("do recycle trash often"), lexicon.score("a Trash, bin here"))
    empty = toxicity.learn(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(d, empty, keep=["doc_id"]).collect()} == {0.5}
    assert toxicity.score(d.limit(0), lexicon, keep=["doc_id"]).count() == 0
    odd = toxicity.score(d.withColumn("__text", F.lit(1)).withColumn("__row", F.lit(2)), lexicon, keep=["__text", "__row"])
    assert odd.columns == ["__text", "__row", "score", "predicted"] and odd.first()["__text"] == 1


def license_brute(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    places, found = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_licenses(spark):
    rng = random.Random(3)
    words = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "x", "İ", "K", "é", "\x7f", ",", "GPL"]
    rows = EDGE + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    got = licenses.detected(docs(spark, rows), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *license_brute(t)) for d, t in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    cases = {
        1: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        2: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        3: ("Released under the MIT License.", "mit"),
        4: ("SPDX-License-Identifier: MPL-2.0", "mpl"),
        5: ("the GNU Lesser General Public License", "gpl,lgpl"),
        6: ("permitted in a common room", ""),
    }
    got = licenses.detected(docs(spark, [(k, t) for k, (t, _) in cases.items()]), keep=["doc_id"])
    assert {r.doc_id: r.labels for r in got.collect()} == {k: v for k, (_, v) in cases.items()}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(licenses.rules()) > 200 and all(re.compile(r) for _, _, r, _ in licenses.rules())


def strings_of(regex):
    """Strings that a rule's regex takes: each alternative, each option with and without, one character of a range."""
    from re import _constants as c, _parser

    def of(parsed):
        out = [""]
        for op, arg in parsed:
            if op is c.LITERAL:
                step = [chr(arg)]
            elif op is c.NOT_LITERAL:
                step = ["~"]
            elif op is c.IN:
                step = [chr(v if k is c.LITERAL else v[0]) for k, v in arg]
            elif op is c.BRANCH:
                step = [s for branch in arg[1] for s in of(branch)]
            elif op is c.SUBPATTERN:
                step = of(arg[-1])
            elif op is c.MAX_REPEAT:
                once = of(arg[2])
                step = [s * n for n in {arg[0], min(arg[1], arg[0] + 1)} for s in (once if n else [""])]
            else:
                assert op is c.ASSERT_NOT, op
                continue
            out = [a + b for a in out for b in dict.fromkeys(step)]
        return out

    return of(_parser.parse(regex))


def test_license_keywords(spark):
    for label, key, regex, _ in licenses.rules():
        for s in strings_of(regex):
            assert re.fullmatch(regex, s) and key in s and any(k in s for k in licenses.STEMS), (label, key, s)
    cases = {
        1: ("GNU Library General Public License", "gpl,lgpl"),
        2: ("It may not be copied or distributed.", "proprietary"),
        3: ("licensed under Apache 1.1", "apache"),
        4: ("licensed under ASL 2", "apache"),
    }
    got = licenses.detected(docs(spark, [(k, t) for k, (t, _) in cases.items()]), keep=["doc_id"])
    assert {r.doc_id: r.labels for r in got.collect()} == {k: v for k, (_, v) in cases.items()}


def labels_brute(t):
    """All rules over the words, without keywords; an interval goes if one that contains it ranks before it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    line = f" {' '.join(words)} "
    found = [(m.start(), m.end(), p, -o, label) for o, (label, _, r, p) in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{r})(?= )", line)]
    left = [x for x in found if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or y[2] == x[2] and (y[:2] != x[:2] or y[3] > x[3])) for y in found)]
    base = [label for phrase, label in licenses.BASE.items() if f" {phrase} " in line]
    return ",".join(sorted({x[4] for x in left} | set(base))), 1 - 0.5 ** (min(100, sum(x[2] for x in left)) / 2)


def test_license_labels_and_score(spark):
    rng = random.Random(29)
    strings = [rng.choice(every) for every in (strings_of(r) for _, _, r, _ in licenses.rules()) for _ in range(2)]
    rows = []
    for i in range(250):
        parts = [rng.choice(strings) if rng.random() < 0.5 else " ".join(rng.choice(["the", "of", "gnu", "cc", "license", "x1"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 8))]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(p.title() if rng.random() < 0.3 else p for p in parts)))
    rows += [(1000 + i, s) for i, s in enumerate(strings[::7])] + EDGE
    got = licenses.detected(docs(spark, rows), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.labels, round(r.score, 9)) for r in got) == Counter((d, x, round(y, 9)) for d, t in rows for x, y in [labels_brute(t)])
    odd = spark.createDataFrame([(1, "MIT License", 5, 6, 7)], "doc_id long, text string, __w int, __s int, __row int")
    r = licenses.detected(odd, keep=["__w", "__s", "__row"]).first()
    assert (r["__w"], r["__s"], r["__row"], r.labels) == (5, 6, 7, "mit")
    assert licenses.detected(odd.limit(0), keep=["doc_id"]).count() == 0


def quality_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality(spark):
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice(["a ", "b ", "c\n", "a b c ", "é#", "　", "<|\t", "\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
        assert quality.statistics(t) == quality_brute(t)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randint(60, 200)))) for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(100))) for i in range(12)]
    rows = good + junk + EDGE
    d = spark.createDataFrame([(*r, "en" if r[0] != 5 else None, "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = quality.judged(d, keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *quality_brute(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert quality.judged(d.limit(0), keep=["doc_id"]).count() == 0


def plain_mcd(x, starts=200):
    """Minimum covariance determinant by concentration from many random subsets; shares no code with the operator."""
    rng, h, floor = np.random.default_rng(77), math.ceil(0.75 * len(x)), np.diag([0.0625, 0.01, 0.0004, 0.01, 0.01])
    best = (math.inf, None, None)
    for _ in range(starts):
        rows = x[rng.permutation(len(x))[:8]]
        for _ in range(60):
            mean, cov = rows.mean(axis=0), np.cov(rows.T, bias=True) + floor
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
            rows = x[d <= np.sort(d)[h - 1]]
        best = min(best, (np.linalg.det(cov), mean.tolist(), cov.tolist()))
    mean, cov = np.array(best[1]), np.array(best[2])
    return ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)


def test_quality_verdicts_are_those_of_a_plain_estimate(spark):
    rng = random.Random(18)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(900):
        lang, odd = ("en", "de", "fr")[i % 3], i % 11 == 0
        size = (3, 9) if lang == "en" else (6, 14)
        words = [word(rng.randint(*size)) for _ in range(rng.randint(60, 260))]
        if odd:
            words = [w + rng.choice(["###", "|$|", ""]) for w in words] if i % 2 else [word(40) for _ in words]
        rows.append((i, " ".join(words) + "\nthe end" * rng.choice([0, 0, 0, 2]), lang, "s"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(d, keep=["doc_id"]).collect()}
    # fixed values: 0.75 over the share of chi-square with 7 degrees up to the 0.75 quantile with 5; the value of 1e-9
    assert quality.CONSISTENCY == pytest.approx(1.4123, abs=2e-3) and quality.CUTOFF == pytest.approx(51.2, abs=1.0)
    assert quality.chi_square(quality.chi_square_above(0.05, 5), 5) == pytest.approx(0.95) and quality.chi_square_above(0.05, 5) == pytest.approx(11.0705, abs=1e-4)
    for lang in ("en", "de", "fr"):
        own = [r for r in rows if r[2] == lang]
        stats = np.array([quality_brute(t) for _, t, _, _ in own], float)
        lines = np.array([t.count("\n") + 1 for _, t, _, _ in own])
        n, chars, symbols, dups, repeats = stats.T
        passed = (n >= 50) & (repeats <= 0.5 * n)
        x = np.stack([np.log(n), np.log((chars + 1) / n), np.sqrt(symbols / chars), dups / lines, np.sqrt(repeats / n)], 1)
        d2 = plain_mcd(x[passed]) / quality.CONSISTENCY
        ids = [r[0] for r, p in zip(own, passed) if p]
        assert [got[i].kept for i in ids] == (d2 <= quality.CUTOFF).tolist()
        assert [got[i].distance for i in ids] == pytest.approx(d2, rel=0.1, abs=0.3)
        assert 10 < (d2 > quality.CUTOFF).sum() < 40


def check_packing(rows, docs_, tokenizer, size):
    by_doc = Counter()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = Counter()
    for d, t in docs_:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), size)):
            want[d, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    by_doc.update((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert by_doc == want
    return len(sequences)


def test_packing(spark, tokenizer):
    rng = random.Random(11)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["the", "of", "ation", "zq", "<|endoftext|>"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    for size in (64, 2048):
        got = packing.packed(docs(spark, rows), keep=["doc_id"], size=size).collect()
        n = check_packing(got, rows, tokenizer, size)
        total = sum(r.length for r in got)
        assert n <= math.ceil(total / size) * 1.05 + 1
    assert packing.packed(docs(spark, rows).limit(0), keep=["doc_id"]).count() == 0


def test_fast_identifiers(tokenizer):
    ranks = packing.ranked(bpe.default_path())
    count = bpe.PairMerger(bpe.default_path()).count
    # what makes both ways of merging agree on every text
    assert len(ranks) == 50_256 and all(count(t) == 1 for t in ranks)
    encoder = packing.Encoder(bpe.default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or c % 97 == 0)]
    beside = ["".join(f"a{c}b 1{c}2 .{c}! {c}{c} x{c} \n{c} y  {c}{c}z" for c in map(chr, points[i : i + 256])) for i in range(0, len(points), 256)]
    for t in [*texts(4000, 9), "ab" * 2000, "The the, the. (the)", "a <|endoftext|> b", "", *beside]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    # long runs are neither slow nor refused
    assert [len(encoder.encode(c * 300_000)) // 4 for c in (" ", "\n ", "a", "^")] == [300_000, 600_000, 75_000, 75_000]


def test_packing_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    for scale in (1, 3000):
        h = {int(n): int(c) * scale for n, c in Counter(rng.integers(1, 200, 400).tolist()).items()}
        plan = packing.plan(h, 199)
        assert all(sum(p) <= 199 for p, _ in plan)
        used = Counter()
        for p, n in plan:
            for v in p:
                used[v] += n
        assert used == Counter(h)
        assert sum(n for _, n in plan) <= 1.03 * math.ceil(sum(k * v for k, v in h.items()) / 199) + 2
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]
