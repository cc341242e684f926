"""The corpus pipeline, stage by stage, against plain Python."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from tests.llm.test_pairs import brute_components, brute_lines
from tidewell.llm import curriculum, quality


def write(folder):
    g = random.Random(3)
    vocabulary = ["".join(g.choice("aeioulmnrst") for _ in range(g.randint(3, 8))) for _ in range(600)]
    line = lambda n: " ".join(g.choice(vocabulary) for _ in range(n))
    good = ["\n".join(line(g.randint(6, 20)) for _ in range(g.randint(2, 6))) for _ in range(60)]
    shared = line(30)
    good += [good[0], good[1] + "\n" + line(4), "\n".join(good[2].split("\n")[::-1]), shared, line(9) + "\n" + shared + "\n" + line(8)]
    near = line(60).split()
    good += [" ".join(near), " ".join([*near[:30], "x", "y", *near[30:]])]
    bad = [" ".join("$$#" + g.choice("xyzq") * g.randint(2, 5) for _ in range(g.randint(20, 60))) for _ in range(25)]
    texts = good + bad + [None, ""]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [["a", "b", None][i % 3] for i in range(len(texts))], "n_chars": [len(t or "") for t in texts], "more": 1})
    docs.to_parquet(f"{folder}/documents.parquet")
    labels = pd.DataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))], columns=["doc_id", "quality", "toxic"])
    labels.to_parquet(f"{folder}/labels.parquet")
    return {i: t for i, t in enumerate(texts)}, len(good)


def test_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    texts, n_good = write(folder)
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{len(held)}")
        docs = spark.read.parquet(f"{folder}/{len(held)}")
        assert len(held) == 4 or docs.columns == pipe.COLUMNS, name
        held.append(docs)
    content = lambda df: {r.doc_id: r.text for r in df.collect()}

    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    weights, bias = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    accepted = {}
    for i, t in texts.items():
        at = [b for _, bucket in quality.Features(len(weights)).rows([t]) for b in bucket.tolist()]
        if (np.mean(weights[at], dtype=float) if at else 0.0) + bias >= 0:
            accepted[i] = t
    assert content(held[0]) == accepted
    assert all(i in accepted for i in range(n_good)) and not any(i in accepted for i in range(n_good, n_good + 25))

    gone, lines = brute_lines(sorted(accepted.items())), {}
    for i, t in accepted.items():
        new = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if not t or len(new.encode()) >= 0.2 * len(t.encode()):
            lines[i] = new
    assert content(held[1]) == lines and {60, 61, 62, 63} & set(lines) == {63}  # copies go, the passage's first document stays

    groups = brute_components(sorted(lines.items()), 5, 4, 5)
    left = {i: t for i, t in lines.items() if groups[i][1] == i}
    assert content(held[2]) == left and 65 in left and 66 not in left

    plan = {r.doc_id: (r.position is not None) + (r.position_again is not None) for r in curriculum.mix(held[2]).collect()}
    copies = Counter(r.doc_id for r in held[3].collect())
    assert copies == Counter({i: n for i, n in plan.items() if n}) and all(content(held[3])[i] == left[i] for i in copies)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = held[4].toPandas()
    for i, n in copies.items():
        mine = pieces[pieces.doc_id == i]
        assert mine.length.sum() == n * (len(library.encode(left[i] or "", add_special_tokens=False).ids) + 1)
    assert set(pieces.doc_id) == set(copies) and (pieces.groupby("sequence_id").length.sum() <= 4096).all()

    again = pipe.run(spark, folder)
    key = lambda df: sorted(zip(df.doc_id, df.piece, df.start, df.ids_crc32))
    assert key(again.toPandas()) == key(pieces)


def test_stages_take_empty_tables(spark, tmp_path):
    write(str(tmp_path))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
