"""The n-gram join, the filter audit and the tokenizer crosswalk against brute force."""

import collections
import hashlib
import itertools
import random

import duckdb
import pandas as pd
import pytest

from tessera.llm import audit, crosswalk, tokengroups
from test_corpus import WORD, empty, folder, lower, rows_of, table  # noqa: F401


def shingles(text, k=4):
    words = WORD.findall(lower(text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def joined(rows, k=4, percent=85):
    """(doc_id, size, smallest doc_id reachable) by comparing all pairs."""
    sets = [shingles(x, k) for _, x in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted([(d, len(s), min(least[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def test_op11(spark, folder):
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(spark, "op11_ngram_join", folder)], key=str)
    assert got == joined(table(folder))


def planted(n=360, seed=3):
    """Clusters of edited copies of all degrees around the threshold, chains, subsets, and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(60))
    passage = " ".join(word() for _ in range(40))
    rows, base = [], []
    for i in range(n):
        if i % 40 == 0:
            base = [word() for _ in range(r.choice([7, 9, 30, 80, 200]))]
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            at = r.randrange(len(text))
            text[at : at + r.randrange(2)] = [word()]
        if i % 7 == 0:
            text = text[: max(3, int(len(text) * r.uniform(0.8, 1)))]
        rows.append((i, " ".join(text) + (" " + passage if i % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("size,cells", [(128, 1 << 24), (4, 1 << 10), (1, 1 << 16)])
def test_op11_finds_every_link(spark, size, cells):
    """However sets are grouped and however rough the frequencies are."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r) for r in tokengroups.similar_groups(spark, docs, size=size, cells=cells).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    want = joined(rows)
    assert got == want
    assert 20 < len({c for _, _, c in want}) < len(rows) - 60


@pytest.mark.parametrize("repeats", [1, 8])
def test_tokens_of_sets_of_unlike_sizes_are_left_out(spark, repeats):
    """A token stays with sets whose sizes allow a link, the smaller one having it in front."""
    rows = [
        (1, 100, 1, [7, 8]), (2, 110, 1, [7, 9]),  # alike in size
        (3, 100, 2, [20, 21]), (4, 300, 2, [20, 21]),  # not
        (5, 100, 0, [30]), (6, 118, 1, [30]),  # the smaller one hasn't it in front
        (7, 100, 1, [40]), (8, 5000, 1, [40]), (9, 104, 0, [40]),
    ]
    docs = spark.createDataFrame(rows, "node long, n long, short long, tokens array<long>").coalesce(1)
    got = {(r["token"], r["node"], r["short"]) for r in tokengroups.shared_tokens(spark, docs, 4, 85, repeats=repeats).collect()}
    if repeats == 1:  # handed on at once
        assert got == {(t, i, j < short) for i, _, short, ts in rows for j, t in enumerate(ts) if t not in (8, 9)}
    else:
        assert got == {(7, 1, True), (7, 2, True), (40, 7, True), (40, 9, False)}


def test_op11_of_equal_sets_and_common_tokens(spark):
    """Copies of one text, near copies of it, and a token of very many sets."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base) for i in range(40)] + [(100 + i, base + f" x{i}") for i in range(40)]
    rows += [(200 + i, "a b c d " + " ".join(f"u{i}v{j}" for j in range(5 + 3 * i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r) for r in tokengroups.similar_groups(spark, docs, size=4, cells=1 << 10).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    assert got == joined(rows)


def test_groups_of_one_least_token_are_as_few_as_hold_them(spark):
    rows = [(i, 50, 7, i) for i in range(400)] + [(400 + i, 50, 8, 1) for i in range(100)] + [(500, 50, 9, 1)]
    got = tokengroups.grouped(spark, spark.createDataFrame(rows, "node long, n long, m1 long, m2 long"), 40).collect()
    least = {i: m1 for i, _, m1, _ in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r["gid"]].append(r["node"])
    assert sorted(x for own in by.values() for x in own) == list(range(501))
    assert all(len({least[x] for x in own}) == 1 for own in by.values())
    count = collections.Counter(least[own[0]] for own in by.values())
    assert count[7] <= 10 and 2 <= count[8] <= 3 and count[9] == 1 and max(map(len, by.values())) < 80


def fails(text):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def audited(docs, labels):
    first = {}
    for d, x, _ in docs:
        if d is not None:
            first[x or ""] = min(d, first.get(x or "", d))
    rows = []
    for d, x, lang in docs:
        own = fails(x or "") | {"E": d is not None and d > first[x or ""]}
        known = labels.get(d, (0, 0)) if d is not None else (0, 0)
        rows.append((lang or "", {f for f in own if own[f]}, *known))
    out, shapley = [], collections.Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            now = [r for r in rows if r[0] == part]
            for step, f in enumerate(order):
                gone, now = [r for r in now if f in r[1]], [r for r in now if f not in r[1]]
                shapley[part, f] += len(gone)
                every = [r for r in rows if r[0] == part and f in r[1]]
                out.append([part, "".join(order), step + 1, len(now), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_op12(spark, folder):
    langs = [None if not isinstance(x, str) else x for x in pd.read_parquet(folder + "/documents.parquet").lang]
    docs = [(d, x, lang) for (d, x), lang in zip(table(folder), langs)]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in rows_of(spark, "op12_filter_audit", folder))
    assert got == audited(docs, {0: (1, 0), 3: (1, 0)})


def test_op12_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(audit.OP12_SQL).df()[COLUMNS].itertuples(index=False, name=None))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows_of(spark, "op12_filter_audit", folder)) == want


def test_op12_equal_ids_and_labels_that_differ(spark):
    docs = [(5, "same text", "x"), (5, "same text", "x"), (5, "same text", None), (2, "other", "x"), (9, "same text", "x"), (None, "same text", "x"), (7, "other", "")]
    labels = [(9, 1, 0), (9, 0, 1), (7, None, 1)]
    cells = audit.failures(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = sorted(tuple(r[c] for c in COLUMNS) for r in audit.interactions(spark, cells).collect())
    assert got == audited(docs, {9: (1, 1), 7: (0, 1)})


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crossed(rows):
    """By byte ranges of whole texts' tokens, all pairs of them."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(paths()[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def ranges(ids, size):
        at, out = 0, []
        for i in ids:
            n = size(i)
            out.append((i, at, at + n))
            at += n
        return out

    held, per = collections.Counter(), []
    for d, x in rows:
        a = b = []
        if x:
            ia, ib = tok.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)
            bytes_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in ia]
            bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + x).encode():
                size_a, size_b = dict(zip(ia, map(len, bytes_a))), dict(zip(ib, map(len, bytes_b)))
                a, b = ranges(ia, size_a.get), ranges(ib, size_b.get)
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        held.update(set(links))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        side = lambda t, lo, hi: ",".join(str(i) for i, s, e in t if lo <= s and e <= hi)
        starts = [0, *ends[:-1]] if ends else []
        fast = len(a) < 1500  # the groups of the longest text would take a square of its tokens here
        joined = ";".join(f"{side(a, lo, hi)}|{side(b, lo, hi)}" for lo, hi in zip(starts, ends)) if fast else None
        per.append((d, len(a), len(b), len(ends), links, joined))
    most = collections.Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(d, na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), None if joined is None else hashlib.sha256(joined.encode()).hexdigest() if na else "") for d, na, nb, ng, links, joined in per]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "a  b   c", " leading", "trailing ", "tab\tand\nnew\n\nlines \n x", "日本語 テキスト　です", "<|endoftext|> <s> </s> <0x41> <unk>", "piece ▁ mark▁", "ﬁ é é Ａ İ ſ 👩‍👩‍👧 é", "x" * 3000, "a b  c", "\x00\x01 \x1f \x85", " ", "\n", "don't we'll I'VE 12345 67,890.12 --- ***", "aaa" * 50 + " " + "é" * 40,
]


def check_crosswalk(got, want):
    key = lambda t: str(t[:7])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


@pytest.mark.parametrize("usual", [crosswalk.COMMON, 1, 0])
def test_op13(spark, folder, usual):
    """With all groups broadcast, one, and none."""
    docs = spark.read.parquet(folder + "/documents.parquet").select("doc_id", "text", "words", "size")
    more = spark.createDataFrame([(1000 + i, x, "w", 1) for i, x in enumerate(HARD)], "doc_id long, text string, words string, size int")
    both = docs.unionByName(more).repartition(3)
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in ALIGNED) for r in crosswalk.crosswalk(spark, both, *paths(), common_groups=usual).collect()]
    check_crosswalk(got, crossed(rows))


def test_op13_query_and_a_table_that_starts_anew(spark, folder, monkeypatch):
    got = [tuple(r[c] for c in ALIGNED) for r in rows_of(spark, "op13_crosswalk", folder)]
    check_crosswalk(got, crossed(table(folder)))
    seen = crosswalk.Interned(crosswalk.vocabularies(*paths()))
    first = list(seen.documents(["one two two", None, "three"]))
    held = seen.counted()
    seen.clear()
    assert list(seen.documents(["one two two", None, "three"])) == first and seen.counted() == held
    monkeypatch.setattr(crosswalk, "REMEMBERED", 1)  # words are learned again and again, numbers stay
    for _ in range(3):
        assert sorted(map(str, seen.documents(["three", None, "one two two"]))) == sorted(map(str, first))
    assert seen.counted()[0] == [(k, 4 * n) for k, n in held[0]]
