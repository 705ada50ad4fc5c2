import numpy as np

from almanac.llm import quality


def test_lines_that_stand_late_are_learned(spark):
    plain, shouting = "\n".join(["An ordinary line of quite plain words stands here."] * 80), "\n".join(["|| BUY NOW || $$$ !!! ||"] * 40)
    docs = spark.createDataFrame([(i, f"{plain}\n{shouting}" if i % 2 else plain) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    masks = quality.line_masks(shouting.encode())[0]
    assert (field.viterbi(masks) == quality.BOILERPLATE).all()


def test_training_has_converged():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 1 << len(quality.FEATURES), rng.integers(1, 30)).astype(np.int32) | 1 for _ in range(40)]
    labels = [i % 2 for i in range(40)]
    a, b = quality.fit_field(sequences, labels), quality.fit_field(sequences, labels, near=1e-7)
    assert np.abs(a.weights - b.weights).max() < 0.1 and np.abs(a.moves - b.moves).max() < 0.1

    def likelihood(field):  # by all labellings' sums, line after line
        total, n = 0.0, np.bincount(labels, [len(s) for s in sequences])
        for s, y in zip(sequences, labels):
            e = field.emissions(s)
            z = e[0]
            for row in e[1:]:
                z = np.logaddexp(*(z[:, None] + field.moves)) + row
            total += (e[:, y].sum() + (len(s) - 1) * field.moves[y, y] - np.logaddexp(*z)) * n.sum() / (2 * n[y])
        return 10 * total / n.sum() - 5e-4 * ((field.weights**2).sum() + (field.moves**2).sum())

    best = likelihood(b)
    for _ in range(20):
        moved = quality.LineField(b.weights + rng.normal(size=b.weights.shape) * 0.02, b.moves + rng.normal(size=(2, 2)) * 0.02)
        assert likelihood(moved) < best
