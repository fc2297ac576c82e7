"""Operators 11 to 13 against brute force, with null, empty, tied, repeated and clashing rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("plumbline.llm")

from plumbline.llm import centroids, dialogs, mixing  # noqa: E402
from plumbline.session import table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def clusters_by_hand(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"), v) for i, v in kept)
    centres = [v for _, v in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign()):
            groups[n].append(v)
        for n, own in groups.items():
            centres[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = collections.Counter()
    for d, n in near:
        inertia[n] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), name[n]) for (i, _), (d, n) in zip(kept, near)), key=repr)


def test_centroids_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    got = centroids.cluster_vectors(table(spark, FOLDER, "embeddings")).collect()
    assert sorted(map(tuple, got), key=repr) == clusters_by_hand(rows, 16, 3, 64, 64)


def test_centroids_of_odd_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, -0.26], [0.5, -0.26], [-3.7, 2.0], [1.0, None], [nan, 1.0], [inf, 1.0], None, [], [1.0], [1.0, 2.0, 3.0], [-3.69, 2.01], [40.0, 40.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0]), (None, [9.0, 9.0]), (None, [-9.0, 9.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(4)
    for k in (1, 3, 50):
        assert sorted(map(tuple, centroids.cluster_vectors(frame, k=k, rounds=2, dims=2, scale=4).collect()), key=repr) == clusters_by_hand(rows, k, 2, 2, 4)
    assert centroids.cluster_vectors(frame.filter("vec_id > 99"), dims=2).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def check_mix(docs, rows):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    source = {i: s for i, s, _ in docs}
    totals, taken, expected, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for i, s, _ in docs:
        totals[s] += words[i]
    want = targets_by_hand(totals)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, words[i]) for i, _, _ in docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source == s and r.source_size == totals[s] and r.target == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size and 0 <= r.rate <= 2
        taken[s] += r.taken
        expected[s] += r.rate * r.size
        target[s] = r.target
    for s, t in target.items():
        assert expected[s] == pytest.approx(t, rel=1e-6, abs=0.01)
        own = [words[i] for i, x, _ in docs if x == s and words[i]]
        # nothing single would come closer by more than the bound: the rest is below the smallest document or the tolerance
        assert abs(taken[s] - t) <= max(1e-4 * t, min(own, default=0), 1) + 1
    # rates are a power of the size within a source
    for s in target:
        tilts = {round(np.log(r.rate) / r.size, 9) for r in rows if source[r.doc_id] == s and 0 < r.rate < 2 and r.size}
        assert len(tilts) <= 1 or max(tilts) - min(tilts) < 1e-6


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 40)
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, FOLDER, "documents").collect()]
    docs += [(5000 + k, "hot", "same three words") for k in range(400)] + [(6000, None, "a b"), (6001, None, None), (6002, "empty", ""), (6003, "", "one"), (6004, "Ünï", "x " * 90_000)]
    docs += [(7000 + k, "wide", "w " * (k * k)) for k in range(1, 60)]
    frame = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, source string, text string, target double, n int")
    rows = mixing.mix_sources(frame).collect()
    check_mix(docs, rows)
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_tables(spark):
    shape = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], shape)).collect() == []
    none = mixing.mix_sources(spark.createDataFrame([(1, "a", None), (2, None, " "), (2, None, " ")], shape)).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 3
    same = mixing.mix_sources(spark.createDataFrame([(1, "a", "x y")] * 9 + [(None, "b", "z")] * 4, shape)).collect()
    assert sum(r.taken for r in same if r.source == "b") == 8 and sum(r.taken for r in same if r.source == "a") in (24, 26) and {r.target for r in same} == {8.0, 25.0}


def repaired_by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of (turn, role, text) in order, from the last turn backwards."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    seen, kinds = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    need = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            found += [(0, "", "")] if state in ("", "a") else []
        else:
            role, text = rows[i][1:]
            c, a, out = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, out))
            extra = 3 if kinds[i] == "truncated" else 0
            if kinds[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in step:
                    c, a, out = best(i + 1, step[state, role[:1]], 0)
                    found.append((c + extra, "K" + a, f"\n{role}:{text}" + out))
                c, a, out = best(i + 1, need[state], 0)
                found.append((c + 3 + extra, "R" + a, f"\n{'user' if need[state] == 'u' else 'assistant'}:{text}" + out))
        if inserted < 3:
            c, a, out = best(i, need[state], inserted + 1)
            found.append((c + 3, "I" + a, f"\n{'user' if need[state] == 'u' else 'assistant'}:" + out))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ""))

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(out[1:].encode()).hexdigest()


def ordered(rows):
    def digest(r):
        return hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def grouped(rows):
    groups = collections.defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return groups


def test_repair_of_damaged_conversations_matches_brute_force(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 1, "user", "Hi."), (None, None, None, "x"), (-5, None, "user", None), (-6, 7, "tool", "T!"), (-7, 1, "", "Q?"), (-7, 1, "", "Q?"), (-8, 4, "system", "S.")]
    groups = grouped(damaged_by_hand(rows))
    want = sorted(((c, *repaired_by_hand(ordered(groups[c]))) for c in {r[0] for r in rows}), key=repr)
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost long")
    assert sorted(map(tuple, dialogs.damage_and_repair(frame).collect()), key=repr) == want
    assert dialogs.damage_and_repair(frame.filter("conv_id = 99999")).collect() == []


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_random_conversations_in_pieces(spark, piece, monkeypatch):
    monkeypatch.setattr(dialogs, "PIECE", piece)
    rng = random.Random(piece)
    rows = []
    for conv in range(150):
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "u", "tool", ""]), rng.choice(["a.", "b!", "c", " \n", "", "d? "])))
    rows += [(500, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c" + str(k) + "."])) for k in range(600)]
    rows += [(501, 1, "user", "same.")] * 50
    groups = grouped(rows)
    want = sorted((c, *repaired_by_hand(ordered(own))) for c, own in groups.items())
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert sorted(map(tuple, dialogs.repair_digest(frame).collect())) == want
    audits = {w[0]: w[-2] for w in want}
    after = collections.defaultdict(list)
    for r in sorted(dialogs.repaired_turns(frame).collect(), key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(after[r.conv_id])
        after[r.conv_id].append(r)
    for conv, audit in audits.items():
        assert "".join(r.edit for r in after[conv]) == audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in after[conv]))
