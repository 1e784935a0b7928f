"""The answer exchange as a stream equals the batch job; replayed items count once (S9, U2, F21, W5, section 2.11)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from broadsheet.operators.dedup import dedup_candidates, rank_per_edition
from broadsheet.operators.validate import RETRY_NOTE
from broadsheet.plans.daily import accept
from broadsheet.sources.landed import good_responses, read_responses
from broadsheet.streaming.answers import PROMPT_SCHEMA, read_attempts, start_answer_stream
from broadsheet.streaming.candidates import LANDED_SCHEMA, late_rows, start_candidates_stream

D = [dt.date(2026, 7, 18) + dt.timedelta(days=k) for k in range(4)]
T0 = dt.datetime(2026, 7, 18, 5, 0)
MIN = dt.timedelta(minutes=1)


def _answer(n, ranks=None):
    return json.dumps({"items": [{"rank": r, "category": "industria", "title": f"T{r}", "summary": "S", "why_it_matters": "W",
                                  "url": f"https://n.example/{k}", "source": "A"} for k, r in enumerate(ranks or range(1, n + 1))]})


def _land(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps({"edition_date": r[0].isoformat(), "call_kind": "digest", "key": "", "attempt": r[1], "raw": r[2],
                                                      "landed_at": r[3].isoformat() + "Z"}) for r in rows]
    (folder / name).write_text("\n".join(lines))


def test_answers_out_of_order_and_late(spark, tmp_path):
    prompts, responses, out = str(tmp_path / "prompts"), tmp_path / "responses", str(tmp_path / "out")
    cands = spark.createDataFrame([(d, k, f"https://n.example/{k}", "A", None, f"T{k}", None, "S") for d in D for k in range(8)],
                                  "edition_date date, position int, url string, source string, points long, title string, content string, snippet string")
    runs = spark.createDataFrame([(d, T0, "deepseek") for d in D], "edition_date date, as_of timestamp, provider string")
    spark.createDataFrame([(d, "digest", "", 1, f"ask {d}", T0) for d in D[:3]], PROMPT_SCHEMA).write.parquet(f"{prompts}/first")
    tmp_path.joinpath("responses").mkdir()

    def run():
        q = start_answer_stream(spark, prompts, str(responses), out, cands, runs, name=f"answers-{id(tmp_path)}", available_now=True)
        q.awaitTermination(180)
        assert q.exception() is None

    # the first edition's answer is faulty, the second's comes twice, the third's never; one line is unreadable
    _land(responses, "b.json", [(D[1], 1, _answer(6), T0 + 3 * MIN), "{oops", (D[1], 1, _answer(6), T0 + 3 * MIN)])
    run()
    _land(responses, "a.json", [(D[0], 1, _answer(6, [1, 1, 2, 3, 4, 5]), T0 + 2 * MIN)])
    run()
    got = {(r.edition_date, r.attempt): r for r in read_attempts(spark, out).collect()}
    assert set(got) == {(D[0], 1), (D[1], 1)} and got[D[1], 1].ok and got[D[0], 1].errors == ["A4:rank"]
    asked = [r for r in spark.read.parquet(f"{prompts}/after-*").collect()]
    assert [(r.edition_date, r.attempt) for r in asked] == [(D[0], 2)] and asked[0].prompt.endswith(RETRY_NOTE + "A4:rank")
    # time passes: another edition is asked, and the third one runs out of time
    for k in range(1, 5):
        spark.createDataFrame([(D[3], "digest", "", 1, "ask", T0 + 40 * k * MIN)], PROMPT_SCHEMA).write.parquet(f"{prompts}/later{k}")
        _land(responses, f"c{k}.json", [(D[0], 2, _answer(6), T0 + 4 * MIN), (D[3], 1, _answer(7), T0 + (40 * k + 1) * MIN)])
        run()
    got = [(r.edition_date, r.attempt, r.timed_out, r.ok) for r in read_attempts(spark, out).collect()]
    assert sorted(x for x in got if x[0] == D[0]) == [(D[0], 1, False, False), (D[0], 2, False, True)]
    assert [x for x in got if x[0] == D[1]] == [(D[1], 1, False, True)]
    assert sorted(x for x in got if x[0] == D[2]) == [(D[2], k, True, None) for k in range(1, len([x for x in got if x[0] == D[2]]) + 1)]
    assert 1 <= len([x for x in got if x[0] == D[2]]) <= 3
    batch = accept(good_responses(read_responses(spark, str(responses))).dropDuplicates(["edition_date", "attempt"]), cands, runs)["accepted"]
    stream = accept(read_attempts(spark, out).where("not timed_out").dropDuplicates(["edition_date", "attempt"]), cands, runs)["accepted"]
    cols = ["edition_date", "attempt", "raw", "n_in", "n_dropped"]
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert len(stream.collect()) == 3


def test_unreadable_responses_are_kept_apart(spark, tmp_path):
    _land(tmp_path / "r", "a.json", [(D[0], 1, "x", T0), "{oops", '{"attempt": 2}'])
    df = read_responses(spark, str(tmp_path / "r"))
    assert [r._corrupt_record for r in df.collect() if r._corrupt_record] == ["{oops"]
    assert [tuple(r)[:5] for r in good_responses(df).collect()] == [(D[0], "digest", "", 1, "x")]


def test_replayed_items_and_restarts_give_the_batch_result(spark, tmp_path):
    landing, out, name = str(tmp_path / "landing"), str(tmp_path / "out"), f"replay-{id(tmp_path)}"
    run2 = T0 + dt.timedelta(days=1)

    def items(run, n, first=0):
        return spark.createDataFrame([(run, run.date(), i, f"T{i}", "" if i % 2 else f"S{i}", f"https://n.example/{i % 5}/" + "?utm_x=1" * (i % 2), "src",
                                       run, i % 4) for i in range(first, first + n)], LANDED_SCHEMA)

    first, more = items(T0, 12), items(T0, 5, 12)
    late = 0
    for k, part in enumerate([first, first, more.unionByName(more), first, items(run2, 3), items(T0, 2, 40)]):
        part.write.parquet(f"{landing}/{k}")
        q = start_candidates_stream(spark, landing + "/*", out, name=name, cap=4, available_now=True)
        q.awaitTermination(180)
        late += late_rows(q)
    got = spark.read.parquet(out).where(F.col("edition_date") == T0.date())
    want = rank_per_edition(dedup_candidates(first.unionByName(more).drop("as_of")), cap=4)
    cols = ["edition_date", "seq", "title", "snippet", "url", "points", "position"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert late == 2
