from almanac.operators import sessions
from almanac.sources import files


def test_threads_deeper_than_64_answers_and_circles(spark):
    rows = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(300)] + [("a", "b"), ("b", "c"), ("c", "a"), ("tail", "c"), ("Tail", "tail"), ("self", "self")]
    closed = sessions.thread_closure(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()
    by = {r.id: (r.root, r.depth) for r in closed}
    assert len(closed) == len(rows) and all(by[f"m{i}"] == ("m0", i) for i in range(300))
    assert all(by[x] == ("a", None) for x in ("a", "b", "c", "tail", "Tail")) and by["self"] == ("self", None)


def test_a_long_mail_thread_is_one_document(spark):
    rows = [(f"m{i:03}", f"m{i - 1:03}" if i else None, f"2024-01-01 {i // 60:02}:{i % 60:02}:00", "x@example.com", "s", f"body {i}") for i in range(150)]
    messages = spark.createDataFrame(rows, "message_id string, in_reply_to string, t string, sender string, subject string, body string").selectExpr("*", "cast(t as timestamp) as ts").drop("t")
    assert files.mail_threads(messages).count() == 1
