"""Operators against brute force, round trips and held-out rows, with null, empty, long, tied and clashing inputs."""

import collections
import contextlib
import hashlib
import random
import re
import threading
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("plumbline.llm")

from plumbline.llm import decontam, langid, neardup, packing, pii, secrets, suffixes, tokens, toxicity, vectors  # noqa: E402
from plumbline.llm.common import components  # noqa: E402
from plumbline.session import table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated, long and short texts, a null id, and columns that clash with the operators' own."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, long), (6, long + " tail"), (7, long), (None, long), (8, "a\x00b é 日本 <|endoftext|> don't <B>"), (8, "a\x00b é 日本 <|endoftext|> don't <B>"), (9, " \n\t ")]
    return spark.createDataFrame([(i, t, 1.0, "x", [9]) for i, t in rows], "doc_id long, text string, score double, label string, spans array<int>")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id < 0")


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two"), (3, "gamma")], "item_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (5, 0)], "doc_id long, toxic int")
    langs = odd.withColumnRenamed("label", "lang")
    for run in (
        packing.pack_documents, neardup.linked, secrets.secret_digest, tokens.token_digest, pii.with_surrogates, suffixes.repeat_digest,
        lambda d: decontam.contamination(d, bench), lambda d: toxicity.toxicity(d, labels), lambda d: langid.identify(d.withColumnRenamed("label", "lang")),
        lambda d: toxicity.without_toxic(d, labels), lambda d: decontam.without_passages(d, bench), neardup.one_of_each, secrets.redact_secrets,
    ):
        assert run(odd).count() >= 5
        assert run(none).count() == 0
    assert langs.columns[3] == "lang"
    assert decontam.without_passages(odd, bench).columns == odd.columns == toxicity.without_toxic(odd, labels).columns


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_digest(odd, path).collect()))
    start = 0
    for (doc_id, text), row in zip(rows, got):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert row == (start, doc_id, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for bits in (1, 7, 13, 16, 17):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
        body = tokens.pack(ids, bits)
        assert len(body) == -(-1001 * bits // 8)
        assert (tokens.unpack(body, bits, 0, 1001) == ids).all() and (tokens.unpack(body, bits, 500, 77) == ids[500:577]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_documents_are_the_tokenizers(spark, name, odd, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()] + [(10_000, None), (10_001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    pieces = collections.defaultdict(list)
    for r in packing.pack_documents(frame, path).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {i: sorted(p) for i, p in pieces.items()} == {
        i: [(k, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(x), 2048))] for i, x in ids.items()}
    start = 0
    for r in sorted(tokens.token_digest(frame, path).collect(), key=lambda r: r.doc_id):
        x = ids[r.doc_id].copy()
        x[-1] = 2
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_units_of_hard_characters_and_little_memory(monkeypatch):
    from tokenizers import Tokenizer
    import pyarrow as pa

    path = tokens.default_tokenizer()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(6)
    signs = [*"aAbBzéÉçñßİıΣσςжЖЯёЁ日本語 \t\n'’.,!?<>|-_0123456789½²٣\u0301\x00\x1c\x85\xa0\u3000\u200b😀", "<|endoftext|>", "'s", "'LL", "don't", "<b>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(5000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    data, offsets = tokens.text_buffer(pa.array(texts))
    for memory in (tokens.REMEMBERED, 4096):
        monkeypatch.setattr(tokens, "REMEMBERED", memory)
        encoder = tokens.UnitEncoder(path)
        for lo, hi in tokens.segments(offsets, 20_000):
            ids, counts = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[lo:hi]


def test_packing_keeps_every_capacity_and_every_token(spark):
    docs = table(spark, FOLDER, "documents")
    for rule, limit in (("norm", None), ("dot", 3)):
        rows = packing.pack_documents(docs, rule=rule, max_documents=limit).collect()
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048 and (limit is None or len(parts) <= limit)
        if limit is None:
            assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    place, _ = packing.best_fit(np.array([6, 6, 4]), (100, 9, 60.0), (1, 1, 1))
    assert len(set(place.tolist())) == 2 and place[0] != place[1]  # 36 + 36 > 60, 36 + 16 fits


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for percent in (85, 60):
        holders, parent, shared = collections.defaultdict(list), {i: i for i in sets}, collections.Counter()
        for i, s in sets.items():
            for x in s:
                holders[x].append(i)
        for own in holders.values():
            for k, a in enumerate(own):
                shared.update((a, b) for b in own[k + 1 :])

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        want = sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())
        assert sorted(map(tuple, neardup.linked(table(spark, "/root/testdata/sf0.01", "documents"), percent).collect())) == want


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(1, 400)]
    star = [(1700, i) for i in range(1001, 1400)]
    links = chain + star + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)] + [(7000, 7000), (2, 1), (1, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        one, two = sorted((find(a), find(b)))
        root[two] = one
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted((x, find(x)) for x in list(root))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    a, b = base[:500], base[100:]
    x, y, both = neardup.registers([a, b, base]).astype(int)
    assert (np.maximum(x, y) == both).all()
    assert abs(neardup.estimate([(x > y).sum()], [(x < y).sum()], [500], [500])[0] - 400 / 600) < 0.15


def test_one_row_of_repeated_and_nameless_documents_stays(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(3).replace("w3x59", "other")
    rows = [(1, text(1))] * 3 + [(None, text(2))] * 3 + [(5, text(3)), (None, near), (7, text(4)), (7, text(5)), (None, None), (None, None), (None, text(6))]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, text(1)), (None, text(2)), (5, text(3)), (7, text(4)), (7, text(5)), (None, None), (None, text(6))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_secrets():
    text = 'Password = "abcdef" secret: token: abcdefgh\nAKIA' + "Z" * 16 + " " + "0f" * 12
    assert secrets.listed(secrets.base_spans(text)) == "assign:0:18,access:44:64,hex:65:89"
    pair = "username: robert\nkey x7Gh29Kd0qLm48Zt\nsee https://db.example.com/login"
    assert [k for *_, k in sorted(secrets.linked_spans(pair, []))] == ["linked_id", "linked_secret", "linked_endpoint"]
    assert not secrets.linked_spans("key x7Gh29Kd0qLm48Zt", []) and not secrets.linked_spans(pair.replace("\n", "\n\n"), [])[1:]


def test_long_secrets(spark):
    import base64
    import random

    for size in (48, 51, 64, 3000):
        key = base64.b64encode(random.Random(size).randbytes(size)).decode()
        text = f"account: devstore1\nhttps://devstore1.example.net/files\nAccountKey={key}"
        found = sorted(secrets.linked_spans(text, secrets.base_spans(text)))
        assert [(kind, text[a:b]) for a, _, b, kind in found] == [
            ("linked_id", "devstore1"), ("linked_endpoint", "https://devstore1.example.net/files"), ("linked_secret", key)]
        masked = secrets.redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()["text"]
        assert masked == "account: [SECRET]\n[SECRET]\nAccountKey=[SECRET]"
        assert not secrets.linked_spans(f"see {key} here", [])


def test_findings_in_whole_documents_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    docs += [(90_001, None), (90_002, ""), (90_003, "token = 日本 password='x-y_z=1' 😀 AKIA" + "Q" * 30 + " " + "a0" * 12), (90_004, "PASSWD:abc Secret  :  'abcdef' api-key=abcdef api_KEY=/+=.-_")]

    def by_hand(text):
        text, spans, found = text or "", [], [0, 0, 0]
        for kind, pattern, ok in (
            (0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
            (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
            for m in re.finditer(pattern, text):
                if ok(m):
                    spans.append((m.start(), kind, m.end()))
                    found[kind] += 1
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        return *found, hashlib.sha256(listed.encode()).hexdigest()

    rows = secrets.secret_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == sorted((i, *by_hand(t)) for i, t in docs)
    texts = dict(docs)
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for r in rows:  # masking each union of spans gives the masked text
        want, done = "", 0
        for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x):
            if a >= done:
                want += texts[r.doc_id][done:a] + "[SECRET]"
            done = max(done, b)
        assert clean[r.doc_id] == (want + texts[r.doc_id][done:] if r.spans else texts[r.doc_id])


@pytest.mark.parametrize("unit", ["a-", "a.", "a", "-", ".", "9", ":", "= ", "user ", "http://", "AKIA", "0f", "x+", "\n ", "a.b:80 "])
def test_secret_patterns_are_linear(unit):
    import time

    start = time.time()
    secrets.findings(unit * (1_000_000 // len(unit)) + ": x")
    assert time.time() - start < 15


def test_vectors_of_long_labels_and_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label string, node long, links int"
    long = "label" * 30
    rows = [(1, [1.0, 2.0], long + "a", 1, 1), (2, [1.0, 2.0], long + "b", 1, 1), (3, [1.0, 2.0], long + "a", 1, 1), (None, [1.0, 2.0], long + "a", 1, 1), (4, [], "x", 1, 1), (5, [2.0, 4.0], long + "a", 1, 1)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, shape)).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 0, 4, True), (5, 2, 1, False)]
    assert vectors.near_vectors(spark.createDataFrame([], shape)).collect() == []


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 20))
    v = centres[rng.integers(0, 12, 300)] + 0.18 * rng.standard_normal((300, 20))
    rows = [(i, [float(c) for c in x], int(i % 2)) for i, x in enumerate(v)]
    rows += [(300, rows[0][1], 0), (301, None, 1), (302, [0.0] * 20, 1), (303, [float("nan")] * 20, 0), (304, rows[1][1], None), (305, [1.0, None], 0)]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    v = np.concatenate([v, v[:1]])
    u, label = v / np.linalg.norm(v, axis=1, keepdims=True), np.append(np.arange(300) % 2, 0)
    link = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(301, dtype=bool)
    low = np.arange(301)
    for _ in range(301):
        low = np.minimum(low, np.where(link, low, 999).min(1))
    want = [(i, int(link[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(301)] + [(i, 0, i, True) for i in range(301, 306)]
    assert got == want and link.sum() > 100


def brute_links(v, label, cosine=0.93):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = ((u[:, None] * u[None]).sum(2) >= cosine) & (label[:, None] == label) & ~np.eye(len(v), dtype=bool)
    low = np.arange(len(v))
    while (low != (less := np.minimum(low, np.where(link, low, len(v)).min(1)))).any():
        low = less
    return link, low


def test_vectors_in_many_tiles_and_close_to_the_limit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((30, 12))[rng.integers(0, 30, 500)] + 0.2 * rng.standard_normal((500, 12))
    for i, step in enumerate((-1e-5, -1e-7, -1e-9, 1e-9, 1e-7, 1e-5)):  # pairs that 16 bits cannot tell
        one, two = np.linalg.qr(rng.standard_normal((12, 2)))[0].T
        v[2 * i], v[2 * i + 1] = 100 * one, (0.93 + step) * one + np.sqrt(1 - (0.93 + step) ** 2) * two
    v[490:] = v[100]
    label = np.arange(500) % 2 * (np.arange(500) > 20)
    link, low = brute_links(v, label)
    rows = [(i, [float(c) for c in x], str(y)) for i, (x, y) in enumerate(zip(v, label))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    want = [(i, int(link[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(500)]
    for room in (vectors.TILE_BYTES, 1000):
        monkeypatch.setattr(vectors, "TILE_BYTES", room)
        assert sorted(map(tuple, vectors.near_vectors(frame).collect())) == want


@pytest.mark.parametrize("dims", [2, 8, 13, 64])
def test_every_pair_of_vectors_is_found_once(monkeypatch, dims):
    rng = np.random.default_rng(dims)
    v = rng.standard_normal((60, dims))[rng.integers(0, 60, 600)] + rng.choice([0.03, 0.25], (600, 1)) * rng.standard_normal((600, dims))
    link, _ = brute_links(v, np.zeros(600))
    code = vectors.coded(v)
    monkeypatch.setattr(vectors, "BOX", 7)
    monkeypatch.setattr(vectors, "VISITORS", 100)
    for all_meet in (0, 1e9):
        monkeypatch.setattr(vectors, "NS_ALL", all_meet)
        for home, guest, same, shift in ((code, code, True, 0), (code[250:], code[:250], False, 250)):
            got = [(*sorted((x, y + shift)), z) for i, j, sure in vectors.compared(home, guest, same, 0.14) for x, y, z in zip(i.tolist(), j.tolist(), sure.tolist())]
            inside = lambda x, y: same or (x < 250) != (y < 250)  # noqa: B023, E731
            want = {(x, y) for x, y in zip(*map(lambda z: z.tolist(), np.nonzero(link))) if x < y and inside(x, y)}
            assert len({(x, y) for x, y, _ in got}) == len(got) and len(want) > 10
            assert {(x, y) for x, y, z in got if z} <= want <= {(x, y) for x, y, _ in got}


def test_vectors_do_not_travel_once_a_block(spark):
    """Bytes of shuffle files, looked at again and again while they are there."""
    folders = [Path(d.toString()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    seen, over = {}, threading.Event()

    def look():
        while not over.wait(0.05):
            for f in (f for d in folders for f in d.rglob("shuffle_*.data")):
                with contextlib.suppress(FileNotFoundError):
                    seen[f] = max(seen.get(f, 0), f.stat().st_size)

    v = np.random.default_rng(4).standard_normal((20_000, 64)).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(v), "label": np.arange(20_000) % 2}), "vec_id long, embedding array<float>, label int")
    before = {f for d in folders for f in d.rglob("shuffle_*.data")}
    looks = threading.Thread(target=look)
    looks.start()
    try:
        assert all(r.n_links == 0 for r in vectors.near_vectors(frame).collect())
    finally:
        over.set()
        looks.join()
    assert v.nbytes / 2 < sum(size for f, size in seen.items() if f not in before) < 4 * v.nbytes


def test_languages_and_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) > 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in toxicity.toxicity(docs, table(spark, folder, "labels")).collect() if r.held_out and r.doc_id in labels]
    hit, said, real = sum(p and y for p, y in rows), sum(p for p, _ in rows), sum(y for _, y in rows)
    assert hit > 0.8 * said and hit > 0.6 * real


def test_surrogates_of_names_ibans_and_addresses(spark):
    rows = [(1, "Mr McDonald met Mrs O'Neil and Mr John Michael Smith."), (2, "So Mr Smith wrote to Monsieur Jean-Luc Picard; DE89370400440532013000, GB82 WEST 1234 5698 7654 32"), (3, "10.1.2.3 192.168.0.9 172.20.1.1 8.8.8.8")]
    out = {r.doc_id: r.text for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not re.search("McDonald|O'Neil|Smith|Michael|John|Picard|Luc|WEST", " ".join(out.values()))
    assert re.fullmatch(r"Mr [A-Z][a-z][A-Z][a-z]{5} met Mrs [A-Z]'[A-Z][a-z]{3} and Mr [A-Z][a-z]{3} [A-Z][a-z]{6} [A-Z][a-z]{4}\.", out[1])
    assert out[1].split()[-1].rstrip(".") == out[2].split()[2]  # Smith is one person
    codes = re.findall(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9 ]+", out[2])
    assert len(codes) == 2
    for code in codes:
        code = code.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    a, b, c, d = out[3].split()
    assert a.startswith("10.") and b.startswith("192.168.") and 16 <= int(c.split(".")[1]) < 32 and c.startswith("172.") and 11 <= int(d.split(".")[0]) < 100


@pytest.mark.parametrize("text", ["q@" + "a." * 500_000 + "com", "a." * 500_000 + "@b.com", "-" * 1_000_000, "9" * 1_000_000, "." * 1_000_000, "Mr " + "A'b-" * 250_000, "a@" * 500_000, "12-" * 333_000])
def test_surrogates_in_long_texts(spark, text):
    row = pii.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert len(row.text) == len(text)


def test_surrogates_of_documents_stay_apart_and_together(spark):
    docs = table(spark, FOLDER, "documents")
    found = docs.selectExpr("doc_id", "text").withColumn("e", pii.entities(docs["text"])).filter("size(e) > 0").collect()
    texts = {r.doc_id: r.text for r in pii.with_surrogates(docs.select("doc_id", "text")).collect()}
    by_entity, by_new = collections.defaultdict(set), collections.defaultdict(set)
    for r in found:
        parts, at, end = re.split("|".join(map(re.escape, sorted(set(r.e), key=len, reverse=True))), r.text), 0, texts[r.doc_id]
        if len(parts) != len(r.e) + 1:  # an entity's text also stands where it is none
            continue
        pattern = "(.+?)".join(map(re.escape, parts))
        new = re.fullmatch(pattern, end, re.DOTALL)
        for old, to in zip(r.e, new.groups()):
            if old.count("@") == 1:
                by_entity[old.lower()].add(to.lower())
                by_new[to.lower()].add(old.lower())
    assert len(by_entity) > 3 and all(len(v) == 1 for v in by_entity.values()) and all(len(v) == 1 for v in by_new.values()) and not set(by_entity) & set(by_new)


def test_surrogates(spark):
    rows = [(1, "a.b@c.org +1 (806) 555-0902 36.244.114.98 4463995391413666"), (2, "A.B@C.ORG or +1-806-555-0902; x.y@c.org"), (3, None), (4, "clean text, 12 of 3")]
    out = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mail, phone, ip, card = re.match(r"(\S+) (.+) (\S+) (\S+)$", out[1].text).groups()
    assert out[2].text.split()[0] == mail.upper() and out[2].text.split()[-1].split("@")[1] == mail.split("@")[1] and out[2].text.split()[-1] != mail
    digits = [int(d) for d in reversed(card)]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0 and card != "4463995391413666"
    assert re.sub(r"\D", "", phone) in re.sub(r"\D", "", out[2].text) and not {"a.b@c.org", "36.244.114.98"} & set(out[1].text.split()) and len(ip.split(".")) == 4
    assert out[3].text is None and out[4].text == rows[3][1] and out[4].n_pii == 0


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    rows += [(1000 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + passage[rng.randrange(200) : rng.randrange(250, 400)] + str(k)) for k in range(60)]
    rows += [(2000, "ab" * 300), (2001, None), (2002, "")]
    seen, want = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_benchmark_windows_match_brute_force(spark):
    bench = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()] + [(900, "short item"), (901, None), (902, "!!")]
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()] + [(9000, "A Short, item; short item"), (9001, None)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    want = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    items |= windows[tuple(w[k : k + m])]
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    found = decontam.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), table_bytes=2000)
    one = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(map(tuple, one.collect())) == sorted(want)
    assert sorted((r.doc_id, r.n_hit) for r in found.select("doc_id", "n_hit").collect()) == sorted((w[0], w[2]) for w in want)


def test_kneser_ney_sums_to_one_and_keeps_every_gram():
    rng = random.Random(1)
    texts = ["".join(rng.choice("абвгдеж αβγδε漢字仮名abc") for _ in range(60)) for _ in range(50)]
    codes, counts = np.unique(langid.grams(texts)[0], return_counts=True)
    model = langid.KneserNey(codes, counts)
    assert (model.grams[langid.ORDER][0] == codes).all()
    every = np.arange(1 << langid.BITS, dtype=np.uint64)
    for context in (0, int(codes[5]) >> 16, int(codes[-1]) >> 16, 0xFFFF00000041):  # seen and unseen contexts
        assert np.exp(model.logp(np.uint64((context & 0xFFFFFFFFFFFF) << 16) | every).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    table = langid.GramTable(codes)
    some = np.concatenate([codes, codes + np.uint64(1)])
    assert (table.find(some) == langid.place(codes, some)).all()


def test_languages_of_many_scripts(spark):
    rng = random.Random(2)
    letters = {"ru": "оеаинтсрвл", "el": "αοιετσνηυρ", "zh": "的一是不了人我在有他", "ja": "のにるをはてがしたと", "he": "יוהלארמבתש", "ko": "이다는을에의가고하지"}
    rows = [(n, " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(30)), lang) for n, (lang, s) in enumerate((x for x in letters.items() for _ in range(40)))]
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i][0], lang) for i, _, lang in rows if got[i][1]]
    assert len(held) > 20 and all(a == b for a, b in held)
