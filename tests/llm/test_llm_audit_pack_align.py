"""Filter audit, level packing and token alignment against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from corpus_cases import clashing, docs_of, edge, edge_rows, rows_of, small_batches, words  # noqa: F401

from retenza.llm import filter_audit as fa
from retenza.llm import level_packing as lp
from retenza.llm import token_align as ta
from retenza.llm import tokens
from retenza.llm.packing import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- filter audit
def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, text, _, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": first is not None and (i is None or i > first)}
        parts[source or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out, shapley = [], collections.Counter()
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone),
                            sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own),
                            sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows():
    rng = random.Random(8)
    texts = [" ".join(words(rng, n)) for n in (10, 60, 80)] + ["LOUD " * 60, "a # b " * 30, None, ""]
    rows = [(rng.randrange(300), rng.choice(texts), "en", rng.choice(["a", "b", None, ""]), 1) for _ in range(200)]
    return edge_rows() + rows


def label_rows():
    rng = random.Random(9)
    return [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + \
        [(2, 1, 1), (2, 0, 0), (None, 1, 1)]


COLUMNS = ("part", "filter_order", "step", *fa.COUNTS)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_audit_equals_brute_force(spark, docs_of, small_batches, broadcast):
    labels = spark.createDataFrame(label_rows(), LABELS)
    got = fa.audit(docs_of(audit_rows()), labels, broadcast_blocks=broadcast)
    assert rows_of(got, *COLUMNS) == brute_audit(audit_rows(), label_rows())


def test_audit_with_clashing_columns_and_hashes(spark, docs_of, clashing):
    """Other columns do no harm; texts of one hash are told apart."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame(label_rows(), LABELS)
    assert rows_of(fa.audit(clashing, labels), *COLUMNS) == brute_audit(edge_rows(), label_rows())
    weak = fa.masks(docs_of(audit_rows()), hashed=lambda body: F.pmod(F.xxhash64(body), F.lit(3)))
    assert rows_of(fa.report(fa.mask_counts(weak, labels)), *COLUMNS) == brute_audit(audit_rows(), label_rows())


def test_audit_of_nothing(spark, docs_of):
    assert fa.audit(docs_of([]), spark.createDataFrame([], LABELS)).count() == 0


def test_sketch_clears_only_unique_texts(spark):
    """Every hash that comes twice stays; of the others few do."""
    from pyspark.sql import functions as F

    n = 20_000
    hashes = spark.range(n, numPartitions=7).select(F.xxhash64("id").alias("th"))
    twice = hashes.limit(500)
    blocks = n // fa.DOCS_PER_BLOCK
    sketch = fa.counting_sketch(hashes.union(twice), blocks, most=900).withColumnRenamed("block", "k")
    kept = hashes.join(sketch, F.col("k") == fa._block(F.col("th"), blocks)).filter(
        F.col("twice").bitwiseAND(fa._pattern(fa._counters(F.col("th")))) == fa._pattern(fa._counters(F.col("th"))))
    assert kept.join(twice.distinct(), "th", "left_semi").count() == 500
    assert 500 <= kept.count() < 500 + 0.03 * n
    assert sketch.groupBy("k").count().filter("count > 1").isEmpty()


# ---------------------------------------------------------------- level packing
def test_best_level_has_the_least_sum_of_squares():
    rng = random.Random(4)
    levels, counts = lp.LevelArray(64), collections.Counter()

    def total(c):
        return sum(n * n for level, n in c.items() if level & (level - 1))
    for window in range(600):
        size = rng.randint(1, 63)
        sums = {}
        for level in [0, *[h for h, n in counts.items() if n]]:
            if level + size <= 64:
                after = counts.copy()
                after[level] -= level > 0
                if level + size < 64:
                    after[level + size] += 1
                sums[level] = total(after)
        level = levels.best(size)
        assert sums[level] == min(sums.values()) and level == max(h for h in sums if sums[h] == min(sums.values()))
        own = levels.take(level) if level else window
        counts[level] -= level > 0
        if level + size < 64:
            levels.put(level + size, own)
            counts[level + size] += 1
        assert levels.open == sum(counts.values())


@pytest.mark.parametrize("most_open", [2048, 3])
def test_pieces_hold_all_ids_and_need_no_padding(edge, clashing, small_batches, most_open):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    texts = collections.Counter((i, t) for i, t, *_ in edge_rows())
    for docs in (edge, clashing):
        got = lp.pack_levels(docs, A, most_open=most_open).collect()
        sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            by_doc[r["doc_id"]].append(r)
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at and length > 0
                at += length
            assert at <= 2048 and at & (at - 1) == 0
        for doc_id, own in by_doc.items():
            want = collections.Counter()
            for (i, t), n in texts.items():
                if i == doc_id:
                    ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
                    for r in {(r["start"], r["length"], r["ids_crc32"]) for r in own if r["doc_tokens"] == len(ids)}:
                        assert r[0] + r[1] <= len(ids)
                    want[len(ids)] += n * len(ids)
            have = collections.Counter()
            for r in own:
                have[r["doc_tokens"]] += r["length"]
            assert have == want
        single = {i: t for (i, t), n in texts.items() if n == 1 and sum(k[0] == i for k in texts) == 1}
        for i, t in single.items():
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
            assert at == len(ids)


def test_packing_nothing_and_bad_capacity(docs_of, edge):
    assert lp.pack_levels(docs_of([]), A).count() == 0
    with pytest.raises(ValueError):
        lp.pack_levels(edge, A, capacity=1000)


def test_few_documents_are_cut(docs_of):
    """Lengths that fill windows exactly leave little to cut at the end of a task."""
    packer, rng = lp.Packer(2048, 2048, 0), random.Random(3)
    sizes = [max(1, min(9000, int(rng.lognormvariate(6, 1)))) for _ in range(6000)]
    for i, n in enumerate(sizes):
        packer.add(i, np.zeros(n, "<u4"))
    packer.drain()
    whole = sum(-(-n // 2048) for n in sizes)
    assert len(packer.rows) - whole < 0.05 * len(sizes)
    assert len({r[5] for r in packer.rows}) <= sum(sizes) / 2048 + 12


# ---------------------------------------------------------------- token alignment
def brute_align(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    digests, links, held = [], [], collections.Counter()
    for i, t, *_ in rows:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        bytes_a = [bytes(byte_of[c] for c in a_lib.id_to_token(x)) for x in a]
        names = [b_lib.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode()
                   for x, p in zip(b, names)]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            digests.append((i, 0, 0, 0, 0, ""))
            links.append(collections.Counter())
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        own, j, groups, ga, gb = collections.Counter(), 0, [], 0, 0
        for k, (x, end) in enumerate(zip(a, ends_a)):
            begin = end - len(bytes_a[k])
            while ends_b[j] <= begin:
                j += 1
            m = j
            while m < len(b) and ends_b[m] - len(bytes_b[m]) < end:
                own[x, b[m]] += 1
                m += 1
        for end in sorted(set(ends_a) & set(ends_b)):
            na, nb = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[ga:na])) + "|" + ",".join(map(str, b[gb:nb])))
            ga, gb = na, nb
        digests.append((i, len(a), len(b), len(groups), sum(own.values()),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        held.update(own.keys())
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    out = [(i, na, nb, g, n, sum(m for p, m in own.items() if held[p] == top[p[0]]),
            sum(m * held[p] for p, m in own.items()), sha) for (i, na, nb, g, n, sha), own in zip(digests, links)]
    return sorted(out, key=str), sorted((x, y, n, n == top[x]) for (x, y), n in held.items())


def align_rows():
    odd = ["a  b", " lead", "end ", "  ", "x▁y", "x▁ y", "foo\n bar\t\tbaz\r\n", "ﬁ ① x\xa0y​", "a\0b",
           "<|endoftext|> and <s> </s> <unk> <0x41>", "é日本😀 ünï", "....,,,,!!!", "́ x", "don't  stop\x1f"]
    return [r for r in edge_rows() if r[0] != 7] + [(900 + i, t, "en", "z", 1) for i, t in enumerate(odd)] + \
        [(7, " ".join(words(random.Random(2), 3000)), "en", "c", 1)]


ALIGN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("most, piece_bytes", [(2_000_000, 32 << 20), (300, 400)])
def test_alignment_equals_brute_force(docs_of, small_batches, monkeypatch, most, piece_bytes):
    """Also with many small chunks, salted partitions and several merge passes."""
    monkeypatch.setattr(ta, "FAN", 2)
    rows, pairs = ta.align(docs_of(align_rows(), 3), A, B, most=most, piece_bytes=piece_bytes)
    want, want_pairs = brute_align(align_rows())
    assert sorted((tuple(r) for r in rows.select(*ALIGN).collect()), key=str) == want
    assert sorted(tuple(r) for r in pairs.select("a", "b", "documents", "best").collect()) == want_pairs


def test_alignment_with_clashing_columns_and_nothing(clashing, docs_of):
    rows, _ = ta.align(clashing.filter("doc_id is null or doc_id <> 7"), A, B)
    want, _ = brute_align([r for r in edge_rows() if r[0] != 7])
    assert sorted((tuple(r) for r in rows.select(*ALIGN).collect()), key=str) == want
    rows, pairs = ta.align(docs_of([]), A, B)
    assert rows.count() == 0 and pairs.count() == 0


def test_runs_read_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 10_000).astype(np.uint64))
    n = rng.integers(1, 1 << 35, len(keys)).astype(np.uint64)
    got = [np.concatenate(c) for c in zip(*ta.read_frames(ta.frames(keys, n), np.uint64))]
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], n)


def test_pieces_of_texts_are_those_of_the_whole_text(small_batches):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=B), tokens.PieceTokenizer(B, most_parts=50)
    texts = [r[1] for r in align_rows() if r[1]]
    for _ in range(2):
        ids, n = own.encode([" " + t for t in texts])
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == library.encode(texts)
