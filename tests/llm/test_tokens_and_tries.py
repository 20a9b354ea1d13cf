"""Alignment of tokenizers, packing of tokenized documents and the trie of conversations against brute-force versions."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioworks.llm import alignment, prefix_trie, window_packing
from folioworks.llm.queries import OP13, op13_conversation_prefix_trie

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tables = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, key string, row long, n_a int, _table string, length int, ids string"


def texts():
    rng = random.Random(4)
    made = [" ".join("".join(rng.choice(["ab", "er", "the", "Ü", "é", "1", "ing", "'s", "-", "€"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    odd = [None, "", " ", "\n", "a\nb", "a\n\nb", " two  spaces ", "tab\there", "end ", "a▁b", "<|endoftext|> and <s>", "　wide ", "x" * 5000, "word " * 20000, "\x00\x1c", "it's 're", "日本語 テキスト", "👩‍👩 joined"]
    return made + odd + made[:5] * 3 + [made[0]] * 30


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if i == 7 else i // 2, t, "k", i, 1, "t", 2, "x") for i, t in enumerate(texts())], SCHEMA).repartition(3).cache()


# ---- alignment -----------------------------------------------------------------------------------------------


def both():
    a, b = tokenizers.Tokenizer.from_file(tables.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tables.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    names = {chr(c): c for c in plain}
    names |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    bytes_a = lambda i: bytes(names[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def brute_alignment(rows):
    """All pairs of token occurrences whose ranges overlap, by comparing each with each in small windows."""
    a, b, bytes_a, bytes_b = both()
    made = []
    for text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelled = [[f(i) for i in own] for f, own in zip((bytes_a, bytes_b), ids, strict=True)]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            made.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        ranges = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        links, j0 = [], 0
        for i, (x, y) in enumerate(ranges[0]):
            while ranges[1][j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(ranges[1]) and ranges[1][j][0] < y:
                links.append((ids[0][i], ids[1][j]))
                j += 1
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [own.index(e) + 1 for own in ends]
            groups.append("|".join(",".join(map(str, own[p:q])) for own, p, q in zip(ids, at, to, strict=True)))
            at = to
        made.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    counts = Counter(link for m in made if m for link in m[3])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    row = lambda m: (*m[:3], len(m[3]), sum(counts[k] == most[k[1]] for k in m[3]), sum(counts[k] for k in m[3]), hashlib.sha256(m[4].encode()).hexdigest())
    return [row(m) if m else (0, 0, 0, 0, 0, 0, "") for m in made], counts


PATHS = [tables.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def test_alignment_equals_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want, counts = brute_alignment([r["text"] for r in rows])
    assert sum(w[-1] == "" for w in want) >= 3 and any(w[-1] == "" for w, r in zip(want, rows, strict=True) if r["text"] == "a▁b")
    for chunk in (1 << 25, 400):  # one chunk a task, and many
        got, pairs = alignment.align(docs, *PATHS, chunk_bytes=chunk)
        assert Counter(map(tuple, got.collect())) == Counter((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))
        assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == counts


def test_an_aligner_that_forgets_gives_the_same(docs):
    own = alignment.Aligner(*PATHS, most=3, most_links=10)
    some = [t.encode() for t in texts() if t and len(t) < 3000]
    one = alignment._chunk(own, some, [""] * len(some), np.ones(len(some)))
    again = alignment._chunk(own, some[::-1], [""] * len(some), np.ones(len(some)))
    assert one[0].column("groups_sha256").to_pylist() == again[0].column("groups_sha256").to_pylist()[::-1]
    assert (one[2] == again[2]).all() and (one[3] == again[3]).all()


def test_a_chunk_takes_a_few_bytes_for_each_of_its_units():
    own = alignment.Aligner(*PATHS)
    words = [f"w{k}" for k in range(1000)]
    some = [" ".join(words[k % 1000] for k in range(i, i + 20_000)).encode() for i in range(50)]
    own.units(some)
    tracemalloc.start()
    alignment._chunk(own, some, [""] * len(some), np.ones(len(some)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * 50 * 20_000


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.align(none, *PATHS)[0].collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a▁b")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in alignment.align(blank, *PATHS)[0].collect()) == [(0, 0, 0, 0, 0, 0, "")] * 3


# ---- windows -------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, window):
    rooms, out = [], []
    for n in sizes:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            least = min(fits)[0]
            k = [k for room, k in fits if room == least][-1]
        else:
            k = len(rooms)
            rooms.append(window)
        rooms[k] -= n
        out.append(k)
    return out, rooms


@pytest.mark.parametrize("window", [1, 7, 16, 2048])
def test_best_fit_takes_the_tightest_window(window):
    rng = random.Random(window)
    sizes = sorted((rng.randrange(1, window + 1) for _ in range(400)), reverse=True)
    at, held = window_packing.best_fit_decreasing(np.array(sizes), window)
    want, rooms = plain_best_fit(sizes, window)
    assert sorted(held.tolist()) == sorted(window - r for r in rooms) and len(at) == len(want)
    room = [window] * len(held)
    for n, k in zip(sizes, at.tolist(), strict=True):
        assert room[k] - n == min((r - n for r in room[: max(k + 1, sum(x < window for x in room))] if r >= n and r < window), default=room[k] - n)
        room[k] -= n


def test_windows_hold_every_id_once(spark, docs):
    for window in (2048, 64):
        pieces = window_packing.cut_windows(docs, PATHS[0], window=window)
        packed = window_packing.pack_windows(pieces, window=window, shard_pieces=16).cache()
        a = tokenizers.Tokenizer.from_file(PATHS[0])
        want = Counter((r["doc_id"], tuple(a.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in docs.select("doc_id", "text").collect())
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in packed.collect():
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
            by_doc[r["doc_id"]].append((r["start"], r["doc_tokens"], tuple(r["ids"])))
            by_sequence[r["sequence_id"]].append(r)
        pool = Counter(p for own in by_doc.values() for p in own)
        assert pool == Counter((k, len(ids), ids[k : k + window]) for (_, ids), n in want.items() for _ in range(n) for k in range(0, len(ids), window))
        for own in by_sequence.values():
            own.sort(key=lambda r: r["offset"])
            ends = np.cumsum([r["length"] for r in own])
            assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] == own[0]["sequence_tokens"] <= window
            assert own[0]["padded"] == (ends[-1] if bin(ends[-1]).count("1") == 1 else window)
        whole = {r["sequence_id"]: r for r in window_packing.sequences(packed, pad_id=-1).collect()}
        assert set(whole) == set(by_sequence)
        for k, r in whole.items():
            ids = [i for own in by_sequence[k] for i in own["ids"]]
            assert r["ids"] == ids + [-1] * (by_sequence[k][0]["padded"] - len(ids))
    assert window_packing.pack_windows(window_packing.cut_windows(spark.createDataFrame([], SCHEMA), PATHS[0], ids=False)).collect() == []


# ---- trie ----------------------------------------------------------------------------------------------------


def brute_trie(members):
    """members: id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = lambda k: len(k[-1][1].encode().split()) if k else 0
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = Counter(), Counter()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(nodes[k]) - 1) * words(k)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[k] if len(members[c]) == len(k)))).encode()).hexdigest()
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in nodes.items())


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(own[c])] for c in own}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 47), *range(60, 66), -3, -25, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 8, 9, 17, 40])):
            rows.append((c, t, rng.choice(["user", "system", None]), rng.choice(["hi", "hi there you", "a  b\tc", "", None, "é è"])))
    same = [(c, t, "user", f"same {t}") for c in range(2000, 2100) for t in range(12)]
    odd = [(None, 1, "user", "no id"), (3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "system", "tie"), (1, 0, "ab", "c"), (21, 0, "a", "bc")]
    return rows + same + odd


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, id int").repartition(5)
    got = prefix_trie.trie(*prefix_trie.with_shared_openings(prefix_trie.turn_ids(table)))
    assert Counter(tuple(r[f] for f in FIELDS) for r in got.collect()) == brute_trie(rebuilt(rows))
    plain = prefix_trie.turn_ids(table)
    got = prefix_trie.trie(plain, plain.select("conv_id").distinct())
    own = {c: turns for c, turns in rebuilt([r for r in rows]).items()}
    assert got.where("depth = 0").collect()[0]["n_convs"] == len(own)


def test_stretches_of_blocks_name_nodes_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    rows = [(c, t, "user", f"{t // 30 * (c % 3)} {t}") for c in range(9) for t in range(45 + c)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turn_ids(table)
    got = prefix_trie.trie(turns, turns.select("conv_id").distinct())
    members = defaultdict(list)
    for c, _, role, text in rows:
        members[c].append((role, text))
    assert Counter(tuple(r[f] for f in FIELDS) for r in got.collect()) == brute_trie(members)


def test_trie_query_and_empty_table(spark, tmp_path):
    import duckdb

    kinds = "conv_id long, turn long, role string, text string"
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/a/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/a/conversations.parquet/*.parquet')")
    want = Counter(con.execute(f"SELECT {', '.join(FIELDS)} FROM ({OP13})").fetchall())
    assert Counter(tuple(r[f] for f in FIELDS) for r in op13_conversation_prefix_trie(spark, f"{tmp_path}/a").collect()) == want
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert op13_conversation_prefix_trie(spark, f"{tmp_path}/b").collect() == []
