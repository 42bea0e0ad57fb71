"""The pipeline stage by stage, and the entry without the training-data part."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerline.llm import bpe, lines, simhash, toxicity
from ledgerline.llm.work import Scratch

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch, seen = docs.columns, Scratch(spark, "t"), [docs]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], SF), name))
    assert all(frame.columns == columns for frame in seen[:-1])
    raw, clean, unique, apart, mixed, encoded = [frame.toPandas() for frame in seen]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.scores(docs, labels, Scratch(spark, "t")).toPandas()
    assert set(clean.doc_id) == set(scores[scores.predicted == 0].doc_id) and len(clean) < len(raw)

    kept = Counter(
        line.lower().strip() for text in unique.text for line in text.split("\n") if len(line.strip()) >= lines.SHINGLE
    )
    assert max(kept.values()) == 1
    assert set(unique.doc_id) <= set(clean.doc_id)

    prints = [simhash.fingerprint(t) for t in apart.text]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    gone = unique[~unique.doc_id.isin(apart.doc_id)]
    assert all(min((simhash.fingerprint(t) ^ p).bit_count() for p in prints) <= 8 for t in gone.text)

    plain = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    want = Counter((i, tuple(plain.encode_ordinary(t))) for i, t in zip(mixed.doc_id, mixed.text))
    assert Counter((i, tuple(map(int, ids))) for i, ids in zip(encoded.doc_id, encoded.ids)) == want


def test_entry_without_the_training_data_part(tmp_path):
    """The rest imports and registers its queries when the operators and the pipeline are gone."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ledgerline.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
