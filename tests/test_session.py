import os

from pitchrank import session as S


def test_scratch_goes_with_the_application(spark):
    table = S.materialize(spark.range(10), "kept")
    assert table.count() == 10
    folder = f"{S.shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.path.isdir(folder)
    S.remove_scratch(spark)
    assert not os.path.exists(folder)
    assert S.materialize(spark.range(3), "again").count() == 3  # and comes again when it is needed
