"""The corpus pipeline stage by stage on a small corpus with planted cases, each against brute force on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from treeloom.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position double"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = {"en": "the of and to in is that for it with was on be by this from are".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht".split()}


def corpus():
    rng = np.random.default_rng(12)
    out = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "er", "ing", "heit", "ly", "em"]) for _ in range(int(rng.integers(40, 160)))]
        out.append([i, " ".join(words), lang, ["b", "a", None, "ä"][i % 4]])
    for k in range(10):  # exact and near copies
        out.append([100 + k, out[k][1], out[k][2], "a"])
        words = out[10 + k][1].split()
        words[len(words) // 2] = "changed"
        out.append([200 + k, " ".join(words), out[10 + k][2], "b"])
    line = "the line that is on this page of it "
    out += [[300 + p, line * 40 + " ".join(rng.choice(WORDS["en"]) + f"q{p}x{i}" for i in range(300)), "en", "a"] for p in range(2)]  # unlike, but for a repeated line
    out += [[7, out[20][1], "en", "b"], [7, out[21][1] + " and more of that", "en", "b"]]  # other texts under an id that is there
    out += [[400, None, "en", "a"], [401, "", "en", "b"], [402, " \t", "de", "b"], [403, "12 34 !!", "en", "b"], [None, out[30][1], "en", "a"], [404, "the long text of it " * 20_000, "en", "c"]]
    out += [out[40], out[40]]
    return [(*r, len(r[1] or ""), 0.5) for r in out]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, by name."""
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        after.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    out["run"] = folder
    return out


def test_stages_keep_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "near-duplicates", "source mixing", "best-fit packing"]
    for name in names[:-1]:
        assert stages[name][2] == SCHEMA.replace(",", "").split()[::2]


def test_rejections_leave_clean_documents(stages):
    before, after, _ = stages["quality classifier"]
    assert {r.doc_id for r in after} >= set(range(90)) and len(after) <= len(before)
    before, after, _ = stages["language ID"]
    gone = Counter(map(tuple, before)) - Counter(map(tuple, after))
    assert not [r for r in gone if r[0] in range(90)]
    assert all(r.text and re.search(r"[^\W\d_]", r.text) for r in after)


def test_near_duplicates_against_brute_force(stages):
    before, after, _ = stages["near-duplicates"]
    sets = []
    for r in before:
        w = re.findall(WORD, (r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= 0.8 * both) if both else True:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    by = defaultdict(list)
    for r, g in zip(before, group):
        by[g].append(r)
    kept = Counter((r.doc_id, r.text) for r in after)
    assert len(after) == len(by)
    for rows in by.values():
        least = min(((r.doc_id is None, r.doc_id or 0) for r in rows))
        assert sum(kept[r] for r in {(x.doc_id, x.text) for x in rows}) == 1
        assert any(kept[x.doc_id, x.text] and (x.doc_id is None, x.doc_id or 0) == least for x in rows)
    kept_ids = {r.doc_id for r in after}
    assert {300, 301} & {r.doc_id for r in before} <= kept_ids and not kept_ids & set(range(100, 110))


def test_mixing_stage_follows_the_plan(spark, stages):
    before, after, _ = stages["source mixing"]
    plan = mixing.plan(spark.createDataFrame(before, SCHEMA)).collect()
    want = Counter({(r.doc_id, r.mark): r.passes for r in plan if r.passes})
    marks = {(r.doc_id, r.mark) for r in plan}
    assert len(marks) == len(plan)  # no equal rows are left after the stage before
    assert sum(want.values()) == len(after)
    by_id = Counter()
    for (doc_id, _), n in want.items():
        by_id[doc_id] += n
    assert Counter(r.doc_id for r in after) == by_id


def test_packing_stage_is_exact(spark, stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["best-fit packing"]
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in before:
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, start, len(ids[start : start + 2048]), zlib.crc32(ids[start : start + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    by = defaultdict(list)
    for r in after:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    again = corpus_pipeline.run(spark, stages["run"]).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in after)


def test_empty_corpus(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
