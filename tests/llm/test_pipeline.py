"""The corpus pipeline, stage by stage, against plain Python."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.brute import best_tiles, jaccard_components
from trailmark.llm import decontaminate, quality

VOCABULARY = [f"word{i}" for i in range(300)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(13)
    path = str(tmp_path_factory.mktemp("corpus"))
    prose = lambda n: rng.choices(VOCABULARY, k=n)
    items = [prose(20) for _ in range(4)]
    texts = [" ".join(prose(rng.randrange(10, 90))) for _ in range(120)]
    texts += [texts[i].upper() for i in range(8)]
    for i in range(8, 16):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(prose(15) + item[10:] + prose(3) + item[:10]) for item in items]
    texts += [" ".join(rng.choice(["BUY!!", "$$$", "###", "NOW!!"]) for _ in range(60)) for _ in range(60)]
    texts += [None, "", "one"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], "en", rng.choice(["a", "b", None]), len(texts[k] or "")) for i, k in enumerate(order)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("$$$" not in (t or "") and "!!" not in (t or "")), 0) for i, t, *_ in rows[:-1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = sorted(tuple(r) for r in docs.collect())
    features = quality.train(docs, labels)
    compress = features.features()
    expected = [r for r in rows if sum(w * x for w, x in zip(features.weights, compress.of(r[1]))) >= 0]
    assert 130 < len(expected) < 160
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "decontamination", "mixing"]

    def stage(name, frame):
        out = stages[name](spark, frame, path)
        assert out.columns == COLUMNS
        return out, sorted(tuple(r) for r in out.collect())

    kept, got = stage("quality_classifier", docs)
    assert got == expected

    last = {}
    for r in expected:
        last[(r[1] or "").lower()] = r
    expected = sorted(last.values())
    kept, got = stage("exact_dedup", kept)
    assert got == expected

    roots, _ = jaccard_components([r[1] for r in expected], 5, 80)
    least = {}
    for r, root in zip(expected, roots):
        least.setdefault(root, r)
    expected = sorted(least.values())
    kept, got = stage("ngram_jaccard_join", kept)
    assert got == expected

    numbers = {}
    code = lambda words: [numbers.setdefault(w, len(numbers) + 1) for w in words]
    coded = [code(i) for i in items]
    leak = lambda text: any(best_tiles(i, code(decontaminate.words_of(text)), decontaminate.MIN_TILE) >= decontaminate.COVERAGE * len(i) for i in coded)
    clean = [r for r in expected if not leak(r[1])]
    assert len(expected) - len(clean) == 4
    kept, got = stage("decontamination", kept)
    assert got == clean

    mix = stages["mixing"](spark, kept, path).collect()
    sizes = {r[0]: len((r[1] or "").encode().split()) for r in clean}
    assert all(r.size == sizes[r.doc_id] and 0 < r.taken <= 3 * r.size for r in mix)
    assert abs(sum(r.taken for r in mix) - sum(sizes.values())) <= 2
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, path).collect()) == sorted((r.doc_id, r.taken) for r in mix)


def test_stages_on_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_tasks_get_texts_in_batches_of_bounded_size(spark):
    from trailmark.session import configure

    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["rows"]) for b in batches)
    rows = configure(spark).range(2500).coalesce(1).mapInArrow(sizes, "rows long").collect()
    assert sum(r.rows for r in rows) == 2500 and max(r.rows for r in rows) <= 1000
