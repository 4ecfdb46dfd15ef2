from plinth.operators import reshape, select


def test_salts_tried_at_once_give_the_slots_of_the_first_that_fits(spark):
    df = reshape.cross_arms(spark.range(30).withColumnRenamed("id", "pair"), ["PE", "Non-PE"])
    got = [sorted(map(tuple, select.blinded_slots(df, "pair", "arm", 3, tries_at_once=n).collect())) for n in (1, 50)]
    assert got[0] == got[1] and sorted(r[2] for r in got[0]) == list(range(1, 61))
