import os

from tarnsieve.storage import checkpoint_root, discard, scratch, written


def folders(spark):
    root = f"{checkpoint_root(spark)}/tarnsieve".removeprefix("file:").replace("//", "/")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scratch_leaves_what_is_kept(spark):
    before = folders(spark)
    with scratch(spark) as keep:
        one = written(spark.range(5), "one")
        with scratch(spark) as keep_inner:
            two = written(one.where("id > 1"), "two")
            written(two, "three")
            keep_inner(two)
        four = written(two.where("id > 2"), "four")
        keep(four)
    left = folders(spark) - before
    assert len(left) == 1 and four.count() == 2
    discard(four)
    assert folders(spark) == before


def test_scratch_clears_after_a_failure(spark):
    before = folders(spark)
    try:
        with scratch(spark):
            written(spark.range(3), "lost")
            raise ValueError
    except ValueError:
        pass
    assert folders(spark) == before
