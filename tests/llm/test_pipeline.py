"""The pipeline's stages, one after another, against plain Python on what each is given."""

import collections
import re

import numpy as np
import pytest

pytest.importorskip("plumbline.llm")

import corpus_pipeline  # noqa: E402
from plumbline.llm import secrets, toxicity  # noqa: E402
from plumbline.session import table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Supplied tables with planted copies, benchmark passages, secrets, nulls and repeated rows."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    long = max((d[1] for d in docs if d[1]), key=len)
    more = [long, long + " and one more end", "x y z " + bench[0][1] + " tail", "user: bob password=hunter2hunter2", None, "", "  ", "same words here", "same words here"]
    docs += [(50_000 + i, t, "en", "planted", len(t) if t is not None else None) for i, t in enumerate(more)] + [docs[3], docs[3]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    table(spark, FOLDER, "labels").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_match_brute_force(spark, folder):
    from tokenizers import Tokenizer
    import public_tokenizers

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs, given = table(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        given[name] = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        out = stage(spark, docs, folder)
        assert name == "packing" or out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    # toxicity: exactly what the score rejects goes
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()}
    left = given["near_duplicates"]
    assert left == collections.Counter({k: n for k, n in given["toxicity"].items() if not scored[k[0]]}) and len(left) > 150
    # near duplicates: one row of every component of equal or similar texts
    keys = sorted(left, key=lambda k: k[0])
    sets = []
    for _, t in keys:
        w = re.findall(SPACED, lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = given["decontamination"]
    assert set(kept) <= set(left) and set(kept.values()) == {1}
    assert sorted(root(keys.index(k)) for k in kept) == sorted({root(i) for i in range(len(keys))})
    # decontamination: what holds a window of ten benchmark words goes
    words = lambda t: re.findall(PLAIN, lower(t))
    windows = set()
    for r in table(spark, folder, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()
    hit = lambda t: any(tuple(words(t)[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words(t)) - n + 1))
    assert set(given["secrets"]) == {k for k in kept if not hit(k[1])} and len(given["secrets"]) < len(kept)
    # secrets: every found span is masked, all else stays
    clean = {}
    for i, t in given["secrets"]:
        spans = secrets.findings(t)[1] if t else []
        clean[i] = secrets.masked(t, spans, "[SECRET]") if spans else t
    assert {i: t for i, t in given["packing"]} == clean and sum("[SECRET]" in (t or "") for t in clean.values()) > 0
    # packing: every token of every document has its place
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    rows, sequences = docs.collect(), collections.defaultdict(list)
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(total) == length
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run_applies_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in rows.collect()}
    assert len(ids) > 100 and 50_000 + 3 in ids and not {50_002} & ids


def test_stages_take_empty_tables(spark, folder):
    none = table(spark, folder, "documents").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
