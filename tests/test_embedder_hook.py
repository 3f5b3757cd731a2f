import numpy as np

from scriptorium.operators.clustering import embed_with


def test_equals_a_plain_loop(spark):
    def make():
        weights = np.arange(1, 4)

        def embed(texts):
            assert 0 < len(texts) <= 7 and all(t.strip() for t in texts)
            return np.array([[(ord(t[0]) * w) % 17 + len(t) for w in weights] for t in texts], float)

        return embed

    texts = [None, "", "  \n", *[f"{chr(97 + i % 26)}é{'x' * (i % 11)}" for i in range(200)]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, body string").repartition(3)
    got = {r["key"]: r["features"] for r in embed_with(df, make, 3, "body", "key", batch_size=7).collect()}
    plain = [[(ord(t[0]) * w) % 17 + len(t) for w in (1, 2, 3)] if t and t.strip() else [0, 0, 0] for t in texts]
    assert [got[str(i)] for i in range(len(texts))] == plain
    assert embed_with(df.limit(0), make, 3, "body", "key").count() == 0
