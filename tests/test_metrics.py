"""Golden scores and invariants of the metric operators."""

import pytest
from pyspark.sql import functions as F

from arbora.operators import metrics as m
from arbora.operators import taxonomy as tx

# ---------------------------------------------------------------- fixed values
# Golden label/prediction lists (20 pairs each) and the scores they must give.
GOLDEN_ICECAT_LABELS = [
    "Notebooks", "Ink_Cartridges", "Toner_Cartridges", "Notebooks", "Notebooks", "Servers",
    "Motherboards", "Notebook_Spare_Parts", "Warranty_&_Support_Extensions", "Fibre_Optic_Cables",
    "Notebook_Spare_Parts", "Toner_Cartridges", "Digital_Photo_Frames", "Notebooks",
    "Notebook_Spare_Parts", "Notebooks", "Notebooks", "PCs/Workstations", "PCs/Workstations",
    "Notebook_Cases"]
GOLDEN_ICECAT_PREDS = [
    "IT_Courses", "Notebooks", "Toner_Cartridges", "AV_Extenders", "Notebooks", "Servers",
    "Other_Input_Devices", "Notebooks", "Warranty_&_Support_Extensions", "Fibre_Optic_Cables",
    "Cable_Splitters_or_Combiners", "Stick_PCs", "Digital_Photo_Frames", "Notebooks", "Notebooks",
    "Projection_Screens", "Cable_Splitters_or_Combiners", "Cable_Splitters_or_Combiners",
    "Cable_Splitters_or_Combiners", "Notebook_Cases"]
GOLDEN_GS1_LABELS = [
    "51121600_Vitamins/Minerals/Nutritional_Supplements", "64010200_Personal_Carriers/Accessories",
    "67010800_Upper_Body_Wear/Tops", "67010800_Upper_Body_Wear/Tops", "86011100_Toy_Vehicles_�_Non-ride",
    "67010800_Upper_Body_Wear/Tops", "75010300_Household/Office_Tables/Desks", "75030100_Ornaments",
    "64010200_Personal_Carriers/Accessories",
    "79010700_Plumbing/Heating_Ventilation/Air_Conditioning_Variety_Packs", "67010300_Lower_Body_Wear/Bottoms",
    "67010300_Lower_Body_Wear/Bottoms", "67010800_Upper_Body_Wear/Tops",
    "50202300_Non_Alcoholic_Beverages_�_Ready_to_Drink", "67010800_Upper_Body_Wear/Tops",
    "10101600_Pet_Nutritional_Supplements", "77030100_Cars", "67010100_Clothing_Accessories",
    "65010100_Computer/Video_Game_Accessories", "67010800_Upper_Body_Wear/Tops"]
GOLDEN_GS1_PREDS = [
    "51121600_Vitamins/Minerals/Nutritional_Supplements", "51101600_Drug_Administration",
    "67010800_Upper_Body_Wear/Tops", "67010100_Clothing_Accessories", "70011300_Arts/Crafts_Variety_Packs",
    "67010800_Upper_Body_Wear/Tops", "75010300_Household/Office_Tables/Desks", "75030200_Pictures/Mirrors/Frames",
    "64010200_Personal_Carriers/Accessories",
    "79010700_Plumbing/Heating_Ventilation/Air_Conditioning_Variety_Packs", "67010300_Lower_Body_Wear/Bottoms",
    "67010300_Lower_Body_Wear/Bottoms", "67010200_Full_Body_Wear", "50193800_Ready-Made_Combination_Meals",
    "67010800_Upper_Body_Wear/Tops", "86010400_Developmental/Educational_Toys", "77030100_Cars",
    "67010100_Clothing_Accessories", "71011600_Sporting_Firearms_Equipment", "67010800_Upper_Body_Wear/Tops"]


def _scores(spark, labels, preds):
    df = spark.createDataFrame(list(zip(labels, preds)), "label string, pred string")
    return m.leaf_scores(df, "label", "pred").first()


def test_golden_icecat_leaf_scores(spark):
    r = _scores(spark, GOLDEN_ICECAT_LABELS, GOLDEN_ICECAT_PREDS)
    assert round(r.weighted_prec, 2) == 0.47
    assert round(r.weighted_rec, 2) == 0.40
    assert round(r.weighted_f1, 2) == 0.43
    assert round(r.weighted_f1, 4) == 0.4258
    assert round(r.macro_f1, 4) == 0.3547
    assert r.n_labels == 17


def test_golden_gs1_leaf_scores(spark):
    r = _scores(spark, GOLDEN_GS1_LABELS, GOLDEN_GS1_PREDS)
    assert round(r.weighted_prec, 3) == 0.725
    assert round(r.weighted_rec, 3) == 0.600
    assert round(r.weighted_f1, 3) == 0.640
    assert round(r.macro_f1, 4) == 0.3567
    assert r.n_labels == 20


def _q1_tree(spark):
    # edges 0->1, 1->2, 1->3, 0->4, 4->5
    return spark.createDataFrame(
        [(0, "Root", None, 0), (1, "A", 0, 1), (2, "A1", 1, 2), (3, "A2", 1, 2), (4, "B", 0, 1), (5, "B1", 4, 2)],
        "id int, name string, parent_id int, depth int")


@pytest.mark.parametrize("compat,tp,n,hf", [(False, 3, 4, 0.75), (True, 2, 3, 0.6667)])
def test_hierarchical_f1_root_collision(spark, compat, tp, n, hf):
    nodes = _q1_tree(spark)
    items = spark.createDataFrame([(2, 3), (5, 5)], "label_id int, pred_id int")
    c = m.level_counts(items, nodes, compat=compat).where(F.col("scope") == "h")
    tot = c.agg(F.sum("tp"), F.sum("sup"), F.sum("np")).first()
    assert tuple(tot) == (tp, n, n)
    h = m.hierarchical_f(c).first()
    assert round(h.h_fbeta, 4) == hf


def test_perfect_predictions_give_one(spark):
    nodes = _q1_tree(spark)
    items = spark.createDataFrame([(2, 2), (3, 3), (5, 5)], "label_id int, pred_id int")
    b = {r.metric: r.value for r in m.bundle(items, nodes).collect()}
    assert b["h_f1"] == 1.0 and b["leaf_weighted_f1"] == 1.0 and b["average_macro_f1"] == 1.0


def test_last_level_equals_leaf_when_depth_uniform(spark):
    nodes = _q1_tree(spark)
    items = spark.createDataFrame([(2, 3), (5, 5), (3, 3), (2, 5)], "label_id int, pred_id int")
    b = {r.metric: r.value for r in m.bundle(items, nodes).collect()}
    assert b["weighted_f1_lvl_2"] == pytest.approx(b["leaf_weighted_f1"])


def test_ragged_prediction_paths_pad_with_dummy(spark):
    nodes = _q1_tree(spark)
    # predicting the inner node 4 for leaf 2: the prediction path is shorter
    items = spark.createDataFrame([(2, 4), (5, 5)], "label_id int, pred_id int")
    c = {(r.scope, r.label): (r.tp, r.sup, r.np) for r in m.level_counts(items, nodes).collect()}
    assert c[("lvl_2", 7)] == (0, 0, 1)          # dummy = node count + 1
    assert c[("lvl_1", 1)] == (0, 1, 0)


def test_out_of_category_root_prediction(spark):
    nodes = _q1_tree(spark)
    items = spark.createDataFrame([(2, 0)], "label_id int, pred_id int")
    c = {(r.scope, r.label): (r.tp, r.sup, r.np) for r in m.level_counts(items, nodes).collect()}
    assert c[("h", -1)] == (0, 2, 0)              # the root adds nothing to hF1
    assert c[("lvl_1", 0)] == (0, 0, 1)


def test_loss_summary(spark):
    df = spark.createDataFrame([(0.5,), (0.25,)], "p double")
    r = m.loss_summary(df).first()
    import math
    assert r.mean_loss == pytest.approx((math.log(2) + math.log(4)) / 2)
    assert r.perplexity == pytest.approx(math.exp(r.mean_loss))
    assert r.focal_loss == pytest.approx((0.25 * 0.25 * math.log(2) + 0.25 * 0.5625 * math.log(4)) / 2)


def test_taxonomy_first_seen_ids_and_paths(spark):
    offers = spark.createDataFrame(
        [(1, "b", "b x", "b x 1"), (0, "a", "a y", "a y 2"), (2, "a", "a y", "a y 3")],
        "row int, l1 string, l2 string, l3 string")
    nodes = tx.taxonomy_from_levels(offers, ["l1", "l2", "l3"], "row")
    got = {r.name: (r.id, r.parent_id, r.depth) for r in nodes.collect()}
    assert got["a"] == (1, 0, 1) and got["a_y"] == (2, 1, 2) and got["a_y_2"] == (3, 2, 3)
    assert got["b"] == (4, 0, 1) and got["a_y_3"][1] == 2
    paths = {r.id: list(r.path) for r in tx.with_paths(nodes).collect()}
    assert paths[3] == [1, 2, 3] and paths[0] == []
