"""Rounds of self-training: stopped after any stage and started again, the tables are those of a run in one go."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import joins as J
from quillspark.operators import rounds as R
from quillspark.plans import fixtures as fx
from quillspark.session import scratch_path
from quillspark.sources.tables import Tables
from quillspark.targets import TARGETS

from .conftest import SF_SMALL

OPTIONS = {"most_rounds": 3, "least_gain": -1.0, "num_features": 32}


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def sets(spark):
    t = Tables(spark, SF_SMALL)
    cur = fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS).cache()
    return cur, J.drop_known_ids(fx.essays(t).select("text_id", "full_text"), cur).unionByName(cur.select("text_id", "full_text").limit(3)).cache()


def table(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))


def test_rounds_resume_after_any_stage(spark, sets):
    cur, rest = sets
    steps = []
    best, rounds, ended = R.self_training(spark, cur, rest, scratch_path(spark, "rounds"), done=lambda n, s: steps.append((n, s)), **OPTIONS)
    assert steps == [(n, s) for n in range(3) for s in ("oof", "pseudo", "score")] and not ended
    assert best.mcrmse == min(r.mcrmse for r in rounds)
    assert rounds[1].pseudo(spark).count() == 5 * (rest.count() - 3)
    # a pseudo label changes what the next round learns
    assert not close(table(rounds[0].oof(spark)), table(rounds[1].oof(spark)))
    root, seen = scratch_path(spark, "rounds"), []

    def stop(number, stage):
        seen.append((number, stage))
        raise Stopped
    for _ in range(9):                                      # one stage a run
        with pytest.raises(Stopped):
            R.self_training(spark, cur, rest, root, done=stop, **OPTIONS)
    again = R.self_training(spark, cur, rest, root, done=stop, **OPTIONS)[1]
    assert seen == steps
    for a, b in zip(rounds, again):
        assert abs(a.mcrmse - b.mcrmse) < 1e-9
        assert close(table(a.oof(spark)), table(b.oof(spark))) and close(table(a.pseudo(spark)), table(b.pseudo(spark)))


def test_no_label_of_a_fold_reaches_its_model(spark, sets):
    """Shifting the labels of fold 1 leaves the predictions of fold 1 alone, through all rounds."""
    cur, rest = sets
    moved = cur.withColumns({t: F.when(F.col("fold") == 1, F.col(t) + 1.0).otherwise(F.col(t)) for t in TARGETS})
    a, b = (R.self_training(spark, x, rest, scratch_path(spark, "rounds"), **{**OPTIONS, "most_rounds": 2})[1][-1].oof(spark).filter("fold = 1") for x in (cur, moved))
    assert close(table(a), table(b))


def test_the_gain_ends_the_run(spark, sets):
    cur, rest = sets
    _, rounds, ended = R.self_training(spark, cur, rest.limit(0), scratch_path(spark, "rounds"), num_features=32)
    assert ended and len(rounds) == 2 and abs(rounds[0].mcrmse - rounds[1].mcrmse) < 1e-9


def test_texts_are_tokenized_once_for_all_rounds(spark, sets, monkeypatch):
    cur, rest = sets
    calls, places = [], R.scoring.ridge.term_places
    monkeypatch.setattr(R.scoring.ridge, "term_places", lambda *a: calls.append(a) or places(*a))
    rounds = R.self_training(spark, cur, rest, scratch_path(spark, "rounds"), **OPTIONS)[1]
    assert len(rounds) == 3 and len(calls) == 2             # the labelled and the unlabelled texts


def test_tokenized_tables_train_and_score_like_texts(spark, sets):
    cur, rest = sets
    seed = rest.withColumn("fold_model", F.lit(2)).withColumns({t: F.length("full_text") % 7 + F.lit(1.0) for t in TARGETS})
    tokens = R.scoring.tokenized(rest, num_features=32)
    assert "full_text" not in tokens.columns
    short = seed.drop("full_text").join(tokens.dropDuplicates(["text_id"]), "text_id")
    want = R.scoring.fold_fit_oof(cur, num_features=32, extra_train=seed, extra_fold_col="fold_model", score_also=rest)
    got = R.scoring.fold_fit_oof(cur, num_features=32, extra_train=short, extra_fold_col="fold_model", score_also=tokens)
    assert all(close(table(a), table(b)) for a, b in zip(want, got))


def test_a_self_training_round_tokenizes_each_text_once(spark, monkeypatch):
    """The previous texts train the models of five folds and are scored by them: one tokenization, one for the labelled texts."""
    from quillspark.plans import q_scoring
    calls, places = [], R.scoring.ridge.term_places
    monkeypatch.setattr(R.scoring.ridge, "term_places", lambda *a: calls.append(a) or places(*a))
    assert q_scoring.self_training_round(spark, SF_SMALL).count() and len(calls) == 2
