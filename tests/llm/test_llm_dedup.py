"""Near-duplicates, lines, repeated strings, vectors, components and the pipeline against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import graph, lines, shingles, sieve, simhash, suffixes, vectors
from tallyfield.llm.shared import written


def docs(spark, rows):
    """With columns whose names are those of inner and result columns."""
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, fingerprint int, t1 string").repartition(3)


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(rng, n):
    return ["".join(rng.choice("abcdefghijéü") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, 500)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = roots(600, edges)
    assert got == {i: up[i] for e in edges if e[0] != e[1] for i in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint_brute(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randint(0, 80)))) for i in range(0, 120)]
    base = words(rng, 300)
    for i in range(200, 260):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    return rows + [(300, None), (301, ""), (302, " \t\n"), (303, rows[5][1]), (303, rows[5][1]), (304, "a b"), (305, "A  b")]


@pytest.mark.parametrize("group_rows", [1024, 8])
def test_simhash(spark, group_rows):
    rows = simhash_rows()
    got = simhash.near_duplicates(docs(spark, rows), group_rows=group_rows).collect()
    fps = [fingerprint_brute(t) for _, t in rows]
    up = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = defaultdict(list)
    for i, r in enumerate(up):
        least[r].append(rows[i][0])
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", min(least[r])) for (d, _), f, r in zip(rows, fps, up))


def test_simhash_edges(spark):
    nameless = [(None, "one two three four"), (None, "one two three four"), (None, "five six seven eight nine ten"), (4, "five six seven eight nine ten")]
    got = simhash.near_duplicates(docs(spark, nameless)).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None", "None"]
    kept = simhash.one_of_each(docs(spark, nameless)).collect()
    assert len(kept) == 2 and kept[0].t1 == "z"
    assert simhash.near_duplicates(docs(spark, nameless).limit(0)).count() == 0


def test_gray_index_is_exact():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *[codes ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(20)]]))
    group = np.sort(rng.integers(0, 3, len(codes)))
    index = simhash.GrayIndex(codes, group)
    for most in (0, 2, 4, 9):
        found = {(int(a), int(b)) for x, y in index.search(codes, group, most) for a, b in zip(x, y)}
        assert found == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if group[i] == group[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= most}
    assert (simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)) == np.arange(8)).all()
    assert len(simhash._blocks(10**9, 4, 1024)) > len(simhash._blocks(10**4, 4, 1024)) == 5


def edited_rows():
    rng = random.Random(31)
    rows = [(i, " ".join(words(rng, rng.randint(0, 40)))) for i in range(60)]
    for k in range(6):
        base = words(rng, 200)
        for i in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((100 + 30 * k + i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    return rows + [(400, None), (401, ""), (402, " \t\n"), (403, rows[5][1]), (403, rows[5][1]), (404, "a b"), (405, "A  b"), (406, "a c")]


@pytest.mark.parametrize("group_rows", [256, 8])
def test_pipeline_near_duplicates(spark, group_rows, monkeypatch):
    import corpus_pipeline

    rows = edited_rows()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for _, t in rows]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    near = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    fps = [fingerprint_brute(t) for _, t in rows]
    assert sum((fps[i] ^ fps[j]).bit_count() > 4 for i, j in near) > 100
    up = roots(len(rows), near)
    monkeypatch.setattr(shingles.links, "__defaults__", (5, group_rows))
    monkeypatch.setattr(shingles.one_of_each, "__kwdefaults__", {"words": 5, "group_rows": group_rows})
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter(rows[r][0] for r in set(up))


def test_pipeline_near_duplicates_meet_by_fingerprint(spark, monkeypatch):
    import corpus_pipeline

    # without minima in common, texts meet by the SimHash index alone
    hidden = shingles.links

    def alone(marked, *rest):
        return hidden(marked.withColumn("bands", F.array().cast("array<long>")), *rest)

    monkeypatch.setattr(shingles, "links", alone)
    base = [f"word{i}" for i in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(words(random.Random(4), 200))), (4, None), (5, "")]
    assert (shingles.majority(shingles.shingles(rows[0][1], 5)) ^ shingles.majority(shingles.shingles(rows[1][1], 5))).bit_count() <= 4
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()) == [1, 3, 4]


def lines_brute(rows, depth=3, similar=0.7, least=3):
    """Every line against every template of its leaf, in plain lists; shares nothing with the operator."""
    def tokens_of(line):
        return ["<*>" if any(c.isdigit() for c in t) else t for t in re.split("[ \t\n\x0b\x0c\r]+", line) if t]

    first_of = {}
    for d, t in rows:
        if t is not None:
            first_of[t] = min(first_of.get(t, 1 << 62), d)
    texts_of = {}  # leaf -> line -> texts
    for t in first_of:
        for line in t.split("\n"):
            if tokens := tuple(tokens_of(line)):
                texts_of.setdefault((len(tokens), tokens[:depth]), {}).setdefault(tokens, set()).add(t)
    gone = {}
    for found in texts_of.values():
        templates = []  # [tokens, lines]
        for line in sorted(found, key=lambda k: (-len(found[k]), k)):
            agree = [sum(a == b for a, b in zip(t, line)) for t, _ in templates]
            best = max(range(len(agree)), key=lambda i: (agree[i], -i), default=None)
            if best is None or agree[best] < similar * len(line):
                templates.append([list(line), [line]])
            else:
                template, members = templates[best]
                templates[best][0] = [a if a == b else "<*>" for a, b in zip(template, line)]
                members.append(line)
        for _, members in templates:
            held = set().union(*(found[k] for k in members))
            if len(held) >= least:
                first = min(held, key=lambda t: first_of[t])
                for k in members:
                    for t in found[k] - {first}:
                        gone.setdefault(t, set()).add(k)
    return Counter((d, None if t is None else "\n".join(x for x in t.split("\n") if tuple(tokens_of(x)) not in gone.get(t, ()))) for d, t in rows)


def test_templates_are_found_without_visiting_all():
    rng = random.Random(7)
    for words_, n in ((3, 7), (40, 11), (2, 4)):
        leaf, plain = lines.Leaf(0.7), []
        for _ in range(400):
            line = ["a", "b", "c", *("<*>" if (w := rng.randrange(words_)) == 0 else f"w{w}" for _ in range(n - 3))]
            agree = [sum(a == b for a, b in zip(t, line)) for t in plain]
            best = max(range(len(agree)), key=lambda i: (agree[i], -i), default=-1)
            if best < 0 or agree[best] < 0.7 * n:
                best = len(plain)
                plain.append(line)
            else:
                plain[best] = [a if a == b else "<*>" for a, b in zip(plain[best], line)]
            assert leaf.add(line) == best
        assert leaf.templates == plain

    def seconds(n):
        leaf, made = lines.Leaf(0.7), [["the", "same", "start", *(f"{rng.random()}" for _ in range(8))] for _ in range(n)]
        began = time.perf_counter()
        for line in made:
            leaf.add(line)
        return time.perf_counter() - began

    assert seconds(8000) < 4


def test_sieve(spark):
    rng = np.random.default_rng(3)
    inside, outside = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    found = sieve.Sieve.of(spark.createDataFrame([(int(v),) for v in inside], "h long"), "h")
    assert found.passes(inside).all() and found.passes(outside).mean() < 0.05
    assert not sieve.Sieve.of(spark.createDataFrame([], "h long"), "h").passes(inside).any()


def test_lines(spark):
    rng = random.Random(12)
    common = [" ".join(words(rng, n)) for n in (1, 3, 6, 9)]
    rows = []
    for i in range(60):
        parts = [" ".join(words(rng, rng.randint(1, 12))) for _ in range(4)] + rng.sample(common, 2)
        parts += [f"Posted on 2024-01-{i:02d} by user{i}", f"Error: the file {words(rng, 1)[0]} was not found here", "", " "]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (103, rows[0][1]), (104, "one line " * 5000)]
    got = lines.deduplicated(docs(spark, rows), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == lines_brute(rows)
    # leaves in chunks: what one template generalises still goes
    chunked = lines.deduplicated(docs(spark, rows), keep=["doc_id"], leaf_lines=5).collect()
    assert "\n".join(r.kept or "" for r in chunked if r.doc_id < 100).count("was not found here") == 1
    assert len(chunked) == len(rows)
    kept = "\n".join(r.kept or "" for r in got if r.doc_id < 100)
    assert kept.count("was not found here") == 1 and kept.count("Posted on") == 1
    assert lines.deduplicated(docs(spark, rows).limit(0), keep=["doc_id"]).count() == 0


def repeats_brute(rows, length, keep_first):
    seen = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((d, p, i))
    out = Counter()
    for i, (d, t) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            w = seen[b[p : p + length]]
            if len(w) > 1 and not (keep_first and min(w) == (d, p, i)):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeated_rows():
    rng = random.Random(5)
    para = lambda n: " ".join(words(rng, n))
    common = [para(60) for _ in range(3)] + [para(30)]
    rows = []
    for i in range(30):
        parts = [para(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(common), para(rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    base = words(rng, 150)
    for i in range(60, 80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    return rows + [(90, "a" * 2000), (91, "ab" * 700), (92, rows[3][1]), (93, rows[3][1]), (94, ""), (95, "x" * 399), (96, "x" * 400), (97, (para(20) + "\n") * 30), (98, None)]


@pytest.mark.parametrize(("keep_first", "group"), [(False, 256), (False, 3), (True, 256), (True, 3)])
def test_suffixes(spark, keep_first, group):
    rows = repeated_rows()
    got = suffixes.remove_repeats(docs(spark, rows), keep=["doc_id"], keep_first=keep_first, group=group).drop("kept").collect()
    assert Counter(map(tuple, got)) == repeats_brute(rows, 400, keep_first)


def test_suffix_edges(spark, monkeypatch):
    rows = [(1, "é" * 300), (2, "é" * 300), (2, "é" * 300), (3, "z" + "é" * 250)]
    got = suffixes.remove_repeats(docs(spark, rows), keep=["doc_id", "t1"], as_text=True).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter({(1, 600): 1, (2, 600): 2, (3, 500): 1}) and {r.kept for r in got} == {"", "z"}
    assert suffixes.remove_repeats(docs(spark, rows).limit(0), keep=["doc_id"]).count() == 0
    # texts longer than a block are cut into blocks
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    covered = [i + k for i, hi in suffixes._blocks(5000, 400) for k in range(hi - i - 399)]
    assert covered == list(range(4601))


def test_texts_over_one_block(spark):
    rng = np.random.default_rng(13)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    passage, edge = "[" + letters(598) + "]", suffixes.BLOCK
    long_ = letters(edge - 300) + passage + letters(3000) + passage + letters(200_000)
    rows = [(1, long_), (2, "#" + passage + "#"), (3, letters(1000))]
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs(spark, rows), keep=["doc_id"], as_text=True).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(1200, 2), (600, 1), (0, 0)]
    assert got[1].kept == long_.replace(passage, "") and got[2].kept == "##"


def test_pipeline_keeps_the_first_of_repeated_strings(spark):
    import corpus_pipeline

    rng = random.Random(17)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = line(600)
    rows = [(i, f"{line(50)}{i}[{passage}]{i}{line(50)}") for i in range(4)]
    full = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    cut = {r.doc_id: r for r in corpus_pipeline.remove_repeated_strings(spark, full, "").collect()}
    assert {d: r.text for d, r in cut.items()} == {d: t if d == 0 else t.replace(f"[{passage}]", "") for d, t in rows}
    assert all(r.n_chars == len(r.text) for r in cut.values())


def test_pipeline_cuts_passages_of_fifty_words(spark):
    import corpus_pipeline

    plain = str.maketrans("éü", "eu")
    passage = " ".join(w.translate(plain) for w in words(random.Random(19), 51))
    assert corpus_pipeline.PASSAGE <= len(passage) < 400
    rows = [(d, t and t.translate(plain)) for d, t in repeated_rows() if d not in (92, 93)] + [(200 + i, f"{'xyz'[i]}{passage}{'zxy'[i]}") for i in range(3)]
    full = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_strings(spark, full, "").collect()}
    assert [cut[200 + i] for i in range(3)] == [f"x{passage}z", "yx", "zy"]
    brute = repeats_brute(rows, corpus_pipeline.PASSAGE, True)
    assert Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in cut.items()) == Counter((k[0], k[-1]) for k in brute)


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    codes = rng.integers(97, 99, 120).astype(np.uint8)
    data, cap = codes.tobytes(), 16
    valid = np.arange(len(codes) - cap + 1)
    sa, previous, later = suffixes.capped_lpf(codes, valid, cap)
    assert [data[i : i + cap] for i in valid[sa]] == sorted(data[i : i + cap] for i in valid)
    common = lambda i, j: next((k for k in range(cap) if data[i + k] != data[j + k]), cap)
    assert previous.tolist() == [max((common(i, j) for j in valid[:i]), default=0) for i in valid]
    assert later.tolist() == [max((common(i, j) for j in valid[i + 1 :]), default=0) for i in valid]


def test_vectors_of_one_dense_cluster(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 32))
    x[600:] = x[0] + 0.12 * rng.normal(size=(300, 32))  # a third of all
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    wanted = (u @ u.T >= 0.95).sum() - len(u)
    found = vectors.near_vectors(df, group_rows=64).agg(F.sum("n_links")).first()[0]
    assert wanted > 50_000 and 0.99 * wanted <= found <= wanted
    kept = vectors.apart_from_each_other(u, 0.95, 1000)
    assert ((kept @ kept.T >= 0.95).sum() == len(kept)) and len(kept) < 650


@pytest.mark.parametrize("group_rows", [512, 16])
def test_vectors(spark, group_rows):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    x = np.concatenate([x, x[:60] + 0.15 * rng.normal(size=(60, 24)), x[0] + 0.05 * rng.normal(size=(80, 24)), 3 * x[:5]])
    rows = [(i, [float(v) for v in e], i % 7) for i, e in enumerate(x.astype(np.float32))]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 24, 0), (1003, [float("nan")] + [1.0] * 23, 0), (1004, [None, *[1.0] * 23], 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [-0.0] * 24, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(df, group_rows=group_rows).collect()}
    assert len(got) == len(rows)
    sound = [(i, np.array(e, float)) for i, e, _ in rows if e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = [(a, b) for a in range(len(sound)) for b in range(a) if len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] >= 0.95 * np.linalg.norm(sound[a][1]) * np.linalg.norm(sound[b][1])]
    n = Counter(i for link in links for i in link)
    up = roots(len(sound), links)
    same = sum(got[i].n_links == n[k] for k, (i, _) in enumerate(sound))
    assert same >= 0.99 * len(sound) and sum(got[i].n_links for i, _ in sound) >= 0.99 * 2 * len(links)
    assert all(got[i].n_links <= n[k] for k, (i, _) in enumerate(sound))
    least = defaultdict(list)
    for k, r in enumerate(up):
        least[r].append(sound[k][0])
    assert np.mean([got[i].component_id == min(least[up[k]]) for k, (i, _) in enumerate(sound)]) >= 0.99
    for i in (1001, 1002, 1003, 1004, 1005, 1008):
        assert tuple(got[i])[1:] == (0, i, True)
    assert got[1007].component_id == 1006 and all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    passage = " ".join(words(rng, 90))
    rows = []
    for i in range(120):
        w = words(rng, rng.randint(60, 120))
        if i % 6 == 0:
            w[3:3] = ["scum", "moron"]
        t = " ".join(w) + (f"\n{passage}" if i % 10 == 1 else "") + ("\nAll common line of text" if i % 3 == 1 else "")
        rows.append((i, t))
    rows += [(200, rows[1][1]), (201, None), (202, ""), (203, rows[2][1] + " end")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, t1 string, g int, __row int, __id string, __t1 int, __text string, __lines int"
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "k", "t", 1, 2, "i", 3, "x", 4) for d, t in rows], columns)
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = df
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, str(tmp_path)), name)
        seen[name] = out
        if name != "best_fit_packing":
            assert [f.name for f in out.schema.fields] == df.columns and {r.kept for r in out.select("kept").collect()} <= {"k"}
    texts = lambda name: {r.doc_id: r.text for r in seen[name].collect()}
    after = texts("toxicity")
    toxic = {d for d, t in rows if t and "scum" in t}
    assert set(after) == {d for d, _ in rows} - toxic and all(after[d] == t for d, t in rows if d in after)
    after = texts("line_dedup")
    assert len(after) == len(rows) - len(toxic) and sum("All common line" in (t or "") for t in after.values()) == 2  # the first, and its copy
    assert Counter((d, t) for d, t in after.items()) == lines_brute([r for r in rows if r[0] not in toxic])
    kept = texts("simhash_near_dedup")
    fps = {d: fingerprint_brute(t) for d, t in after.items()}
    ids = sorted(after)
    up = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 4])
    assert sorted(kept) == sorted({ids[r] for r in up})
    cut = texts("suffix_array_dedup")
    assert set(cut) == set(kept)
    expected = repeats_brute(list(kept.items()), 400, False)
    assert sum(len(t.encode()) for t in cut.values()) <= sum(k[1] - k[2] for k in expected)
    pieces = seen["best_fit_packing"]
    assert {r.doc_id for r in pieces.collect()} == set(cut)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    out = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = out.columns
        out = written(stage(spark, out, str(tmp_path)), name)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == columns)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
