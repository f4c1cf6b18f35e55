import functools
import random
import re

import pytest

import corpus_pipeline as P
from equiflow.llm import language_id
from equiflow.llm.decontamination import contaminated_pairs
from equiflow.llm.packing import WINDOW
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_packing import verify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": [f"{a}{b}" for a in ("the", "and", "with", "house", "river") for b in ("", "ly", "ing", "ers")],
         "bb": [f"{a}{b}" for a in ("où", "été", "leçon", "garçon", "maïs") for b in ("", "eux", "ôt", "ée")]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    items = [(k, " ".join(r.choice(WORDS["aa"]) for _ in range(30))) for k in range(4)]
    rows = []

    def add(text, lang="aa"):
        rows.append((len(rows), text, lang, "s", len(text or "")))

    for i in range(240):
        lang = "ab"[i % 2] * 2
        words = [r.choice(WORDS[lang]) for _ in range(r.randrange(30, 120))]
        if i % 10 == 3:
            words[5:5] = r.choice(items)[1].split()
        add(" ".join(words), lang)
        if i % 6 == 1:
            add("  ".join(words) + "\n", lang)  # equal but for white space
        if i % 7 == 2 and i % 10 != 3:
            words[len(words) // 2] = "other"
            add(" ".join(words), lang)  # near copy
    for text in (None, "", "12 34 --", "99"):
        add(text, None)
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(language_id, "train", functools.partial(language_id.train, steps=80))


LEFT = {}  # what the last stage packs, by brute force


def test_stages_and_contract():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert P.ORACLE_SQL is None


def test_each_stage_equals_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(P.STAGES)

    kept = stages["language_id"](spark, docs, path)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    want = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    assert left == want  # clean documents stay, texts without a letter go

    kept = stages["exact_dedup"](spark, kept, path)
    best = {}
    for i, t in left.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (0, i)), (-len(t), i))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in best.values()) and kept.columns == docs.columns
    left = {i: left[i] for _, i in best.values()}

    kept = stages["near_dedup"](spark, kept, path)
    roots = brute_components(sorted(left.items()))
    left = {i: left[i] for i, (_, root) in roots.items() if i == root}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(left) and kept.columns == docs.columns

    benchmark = spark.read.parquet(f"{path}/benchmark.parquet")
    found = {r.doc_id for r in contaminated_pairs(kept, benchmark).collect()}
    verbatim = {i for i, t in left.items() if any(x in " ".join(t.split()) for _, x in items)}
    assert found == verbatim and verbatim
    kept = stages["decontamination"](spark, kept, path)
    left = {i: t for i, t in left.items() if i not in verbatim}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(left) and kept.columns == docs.columns

    LEFT.update(left)


def test_run_packs_what_the_stages_leave(spark, folder):
    verify(P.run(spark, folder[0]).collect(), sorted(LEFT.items()), WINDOW)
