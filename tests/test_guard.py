"""The guard and restoring as one chain, over several runs of a stream."""

from datetime import datetime, timedelta

from textveil.operators import detectors as D
from textveil.streaming.guard import guard, restore_requests

T0 = datetime(2024, 1, 1)
AT = lambda s: T0 + timedelta(seconds=s)


def test_answers_before_their_requests_late_ones_and_repeats(spark, tmp_path):
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/{name}")
    messages, answers = "request_id long, text string, ts timestamp", "request_id long, text string, ts timestamp"
    stream = lambda path, schema: spark.readStream.schema(schema).parquet(f"{d}/{path}")
    policy = {"EMAIL": "MASK", "BANK_CARD_NUMBER": "BLOCK"}

    def step():
        guard(stream("messages", messages), policy, f"{d}/out", f"{d}/guard", detectors=(D.EMAIL, D.CARD), role=None, ts="ts").awaitTermination()
        requests = stream("out/requests", "request_id long, values map<string,string>, ts timestamp")
        out = restore_requests(stream("answers", answers), requests)
        out.writeStream.format("parquet").option("path", f"{d}/restored").option("checkpointLocation", f"{d}/state").trigger(availableNow=True).start().awaitTermination()
        return {(r.request_id, r.text): (r.restored, r.in_time) for r in spark.read.schema(out.schema).parquet(f"{d}/restored").collect()}

    put("messages", [(1, "to a@b.ru and c@d.ru and a@b.ru", AT(0)), (2, "nothing", AT(0)), (3, "x@y.ru", AT(0)), (3, "z@y.ru", AT(40)), (4, "5321 3012 4417 8904", AT(0)), (6, None, AT(0))], messages)
    put("answers", [(1, "<EMAIL_2> <EMAIL_1> <EMAIL_3>", AT(60)), (1, "<EMAIL_1>", AT(61)), (2, "<EMAIL_1>", AT(5)), (3, "first <EMAIL_1>", AT(30)), (3, "then <EMAIL_1>", AT(90)), (4, "<EMAIL_1>", AT(1)), (5, "early <EMAIL_1>", AT(70)), (6, None, AT(3))], answers)
    first = step()
    assert first == {
        (1, "<EMAIL_2> <EMAIL_1> <EMAIL_3>"): ("c@d.ru a@b.ru <EMAIL_3>", True),  # the last second counts
        (1, "<EMAIL_1>"): ("<EMAIL_1>", False),
        (2, "<EMAIL_1>"): ("<EMAIL_1>", True),  # a message without values
        (3, "first <EMAIL_1>"): ("first x@y.ru", True),
        (3, "then <EMAIL_1>"): ("then z@y.ru", True),  # sent again: the later message's time and value
        (6, None): (None, True),
    }
    # a request that comes after its answer, and much later others: what was never asked, or was blocked, stays masked once its time is over
    put("messages", [(5, "p@q.ru", AT(65)), (7, "n@m.ru", AT(5000))], messages)
    put("answers", [(8, "<EMAIL_1>", AT(5000))], answers)
    second = step()
    assert second == first | {(5, "early <EMAIL_1>"): ("early p@q.ru", True), (4, "<EMAIL_1>"): ("<EMAIL_1>", False)}
