"""The five stages against plain Python that does the same work without Spark and without the operators."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cadence.llm import jaccard, language, mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = re.compile(r"[^\x20\x09-\x0D]+")


def key(i):
    return "" if i is None else str(i)


def plain_language(rows):
    """Word-first backoff, a word at a time; nothing is cut, so only for small tables."""
    found = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts = [defaultdict(Counter) for _ in range(6)]
    for i, text, lang, *_ in rows:
        if zlib.crc32(key(i).encode()) % 5 and text is not None and lang is not None:
            for w in found.findall(text.lower()):
                counts[0][lang][w] += 1
                for n in range(1, 6):
                    counts[n][lang].update(grams(w, n))
    # words met once in a language are not on its list
    counts[0] = {k: Counter({w: n for w, n in c.items() if n > 1}) for k, c in counts[0].items()}
    languages = sorted(counts[1])
    sums = [{k: sum(c.values()) for k, c in by.items()} for by in counts]
    log = lambda n, k, x: math.log10(counts[n][k][x] / sums[n][k]) if counts[n][k].get(x) else -math.log10(sums[n][k] + 1) - 0.5
    known = lambda n, x: any(counts[n][k].get(x) for k in languages)

    def word(w, k):
        if known(0, w):
            return log(0, k, w)
        for n in range(min(5, len(w) + 2), 0, -1):
            have = [g for g in grams(w, n) if known(n, g)]
            if have:
                return sum(log(n, k, g) for g in have) / len(have)
        return 0.0

    def told(text):
        ws = found.findall((text or "").lower())
        if not ws or not languages:
            return False
        mean = [sum(word(w, k) for w in ws) / len(ws) * 3.0 * min(len(ws), 20) ** 0.5 for k in languages]
        return 1 / sum(10 ** (m - max(mean)) for m in mean) >= 0.3

    return [r for r in rows if told(r[1])]


def plain_groups(rows):
    sets = []
    for _, text, *_ in rows:
        w = W.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                part[jaccard.find(part, i)] = jaccard.find(part, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[jaccard.find(part, i)].append(i)
    return [rows[min(g, key=lambda i: rows[i][0])] for g in groups.values()]


def plain_masks(rows):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [(assign, 1, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]

    def odd(v):
        h = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
        return sum(map(str.isdigit, v)) >= 3 and sum(map(str.isalpha, v)) >= 3 and h >= 3.5

    cand, owners = [], defaultdict(set)
    for _, text, _, source, *_ in rows:
        base = [(m.start(), m.end(), m[g], True) for p, g, least in kinds for m in p.finditer(text or "") if len(m[g]) >= least]
        more = [(m.start(), m.end(), m[0], False) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text or "") if odd(m[0])]
        more = [m for m in more if not any(a < m[1] and m[0] < b for a, b, *_ in base)]
        cand.append(base + more)
        for c in base + more:
            owners[c[2]].add(source)
    out = []
    for r, found in zip(rows, cand, strict=True):
        text, covered = r[1], set()
        for a, b, v, base in found:
            covered |= set(range(a, b)) if base or len(owners[v]) <= 2 else set()
        if covered:
            text = re.sub("\0+", "[SECRET]", "".join("\0" if i in covered else c for i, c in enumerate(text)))
        out.append((r[0], text, *r[2:]))
    return out


def plain_mix(rows):
    size = lambda r: len(W.findall(r[1] or ""))
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, list(order), 1.5 * sum(sums.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= 2 * sums[s]]
        for s in full or free:
            goal[s] = 2.0 * sums[s] if full else level * weight[s]
        left -= sum(goal[s] for s in full)
        free = [s for s in free if s not in goal]
    out = []
    for s in order:
        mine = [r for r in rows if r[3] == s]
        passes = math.floor(goal[s] / sums[s]) if sums[s] else 0
        rest, upto, edge = goal[s] - passes * sums[s], 0, ""
        by = defaultdict(list)
        for r in mine:
            by[hashlib.md5(key(r[0]).encode()).hexdigest()[:12]].append(r)
        for h in sorted(by):
            z = sum(map(size, by[h]))
            if upto < rest <= upto + z:
                edge = h + "g" if upto + z - rest < rest - upto else h
                break
            upto += z
        for h, found in by.items():
            out += [r for r in found for _ in range(passes + (h < edge))]
    return out


def plain_tokens(rows):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=__import__("cadence.llm.bpe", fromlist=["x"]).load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = []
    for i, text, _, source, *_ in rows:
        ids = other.encode_ordinary(text or "")
        out.append((i, source, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def stage_by_stage(spark, docs, folder):
    """(name, rows) after each stage; each stage gets what was written of the one before."""
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, None).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs))
    return out


def test_against_plain(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    live, copied, odd = "token = 'aB3xY9kLmN2pQ7rS'", "password=hunter2hunter2", "zK8qWv3LpT6nR1xYb9Ds"
    base = rows[0][1][:400]
    rows += [
        (900001, None, None, None, None),
        (900002, "", "en", "web", 0),
        (900003, "12 34 !!", "en", "web", 8),
        (900004, f"{base} {live} {odd}", "en", None, None),
        (900005, f"{base} and then {copied} the thing of that", "en", "books", 1),
        (900006, f"{rows[1][1][:300]} or {copied} here", "en", "web", 1),
        (900007, f"{rows[2][1][:300]} {copied} there", "en", None, 1),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = rows
    plain = [plain_language, plain_groups, plain_masks, plain_mix, plain_tokens]
    for (name, got), step in zip(stage_by_stage(spark, docs, tmp_path), plain, strict=True):
        want = step(want)
        if step is plain_tokens:
            assert sorted((tuple(r) for r in got.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == want
        else:
            assert got.columns == docs.columns
            assert sorted(((r[0], r[1], r[3]) for r in got.collect()), key=str) == sorted(((r[0], r[1], r[3]) for r in want), key=str), name
        assert want, name


CLASH = "lang_pred score held_out _text _h _gone _again _key key digest component_id n_shingles hash owners repositories n_live n_copied n_assign _cand _kept _scanned passes below _source size _time n_tokens _aside0".split()


def test_odd_rows_and_clashing_names(spark, tmp_path):
    text = "the cat and the dog of that house are here and there again"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, None, None, None), (None, text, "en", "b", 0), (3, "der hund und die katze in dem haus", "de", "a", 0), (3, "das ist ein anderes haus mit hund und maus", "de", "a", 0), (4, None, None, None, None), (5, "", "de", "c", 0)]
    docs = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], f"{DOCS}, {', '.join(f'{c} int' for c in CLASH)}")
    kept = sorted(map(str, jaccard.one_of_each(docs).select("doc_id", "text").collect()))
    # a doc_id that two different texts have keeps both; of the group of `text` one row stays
    assert len(kept) == 5 and sum(text in x for x in kept) == 1
    got = stage_by_stage(spark, docs, tmp_path)
    for name, found in got[:-1]:
        assert found.columns == docs.columns, name
    assert [tuple(r)[5:] for r in got[3][1].collect()] == [tuple(range(len(CLASH)))] * got[3][1].count()
    assert {r["doc_id"] for r in got[1][1].collect()} == {1, 3}


def test_null_ids_alone(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text, "en", "a", 0)] * 3 + [(None, "eight nine ten eleven twelve", "en", "a", 0)], DOCS)
    assert sorted(r["text"] for r in jaccard.one_of_each(docs).collect()) == ["eight nine ten eleven twelve", text]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty(spark, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), None).count() == 0


def test_words_seen_once_count(spark):
    """No list is cut: every word of the sample is known, with its own frequency."""
    rows = [(i, f"word{chr(97 + i)}only " + " ".join(f"w{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(300)), "en", None, 0) for i in range(20)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert len(model.tables[0].hashes) == 20 * 301
    at, known = model.tables[0].find(language.Spans(["wordaonly", "waab", "never"]).words())
    assert known.tolist() == [True, True, False]
    assert model.tables[0].logs[at[0], 0] == pytest.approx(-math.log10(20 * 301), abs=1e-5)


def test_sample_is_bounded(spark):
    """Rows that all share one hash don't get past the bound; neither do null ids."""
    rows = [(None, "the same text", "en", None, 0)] * 50 + [(i, f"other {i}", "de", None, 0) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    for n in (1, 7, 55, 60, 99):
        assert language.sampled(docs, n).count() == min(n, 60)


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "mask_secrets", "mix_sources", "tokenise"]
    assert mixing.mixed_documents and secrets.redacted
