import json

from cargoline.operators.custom import classify_with_model


def test_a_users_model_is_loaded_in_tasks_and_gated(spark, tmp_path):
    (tmp_path / "model.json").write_text(json.dumps({"lamp": ["SP lamp", 0.9, 3], "ring": ["SP ring", 0.4, 3], "only": ["SP one", 1.0, 1], "odd": ["SP odd", None, 2]}))

    def load(path):
        import json

        known = json.load(open(path))

        def answer(batch):
            found = [known.get(t, [None, 0.0, 0]) for t in batch["text"]]
            return [f[0] for f in found], [float("nan") if f[1] is None else f[1] for f in found], [f[2] for f in found]

        return answer

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["lamp", "ring", "only", "odd", "new", None, "lamp"])], "row_id bigint, text string").repartition(3)
    got = {r.row_id: (r.label, r.status) for r in classify_with_model(rows, load, str(tmp_path / "model.json")).collect()}
    assert got == {0: ("SP lamp", "auto_model"), 1: ("SP ring", "review"), 2: ("SP one", "auto_single"), 3: ("SP odd", "review"), 4: (None, "review"), 5: (None, "review"),
                   6: ("SP lamp", "auto_model")}
    assert classify_with_model(rows.where("false"), load, str(tmp_path / "model.json")).count() == 0
