"""Small document tables for the operators' tests."""

import random

SF = "/root/testdata/sf0.001"
# Names that operators use for columns of their own.
SCHEMA = ("doc_id bigint, text string, lang string, fp string, node string, line int, "
          "component_id string, shard string, ids string, term string, `key` string")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "fp", "n", 1, "c", "s", "i", "t", "k")
                                  for i, t in rows], SCHEMA).repartition(3)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    made = ["".join(r.choice(["ka", "lo", "mi", "ter", "sun", "ve"]) for _ in range(r.randint(1, 4)))
            for _ in range(vocabulary)]
    return " ".join(r.choice(made) for _ in range(n))


def edge_rows():
    long = words(1, 6000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One  two"), (6, "one two three"),
            (7, long), (8, long), (9, long + " tail"), (10, "Ünïcode 漢字 🙂 text here"),
            (11, words(2, 60)), (12, words(2, 60)), (13, words(3, 60) + "\n" + words(4, 40)),
            (14, words(3, 60) + "\n\n" + words(5, 40)), (None, "no id"), (None, words(2, 60)),
            (20, "same id"), (20, "same id"), (21, "!!! ??? ..."), (22, "a\r\nb\x00c\x1fd")]


def documents():
    """(doc_id, text) of the given small table."""
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
