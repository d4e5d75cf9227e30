"""What a model gets at a time."""

from palimpsest.plans import chain


def test_a_model_gets_portions_of_prompts(spark):
    prompts = spark.range(300).coalesce(1).selectExpr(
        "CAST(id AS STRING) AS custom_id", "repeat('x', CAST(100000 + id AS INT)) AS prompt"
    )

    def sizes(texts):
        return [f"{len(t)} of {texts.str.len().sum()}" for t in texts]

    answers = {r.custom_id: r.response.split(" of ") for r in chain.answered(prompts, sizes).collect()}
    assert {int(k): int(v[0]) for k, v in answers.items()} == {i: 100_000 + i for i in range(300)}
    assert max(int(v[1]) for v in answers.values()) <= 2 * chain.PORTION


def test_answers_may_be_missing_or_numbers(spark):
    prompts = spark.createDataFrame([("1", "a"), ("2", None)], "custom_id string, prompt string").coalesce(1)
    nothing = chain.answered(prompts, lambda texts: [None] * len(texts)).collect()
    assert sorted(r.custom_id for r in nothing if r.response is None) == ["1", "2"]
