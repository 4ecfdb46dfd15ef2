import pytest

from plinth.sources import io


@pytest.mark.parametrize("names,fits", [(["a-1"], True), (["a-1", "a-2"], False), ([], False), (["b-1"], False)])
def test_one_path(spark, tmp_path, names, fits):
    for n in names:
        (tmp_path / n).mkdir()
    for session in (None, spark):
        if fits:
            assert io.resolve_one(f"{tmp_path}/a-*", session).endswith("/a-1")
        else:
            with pytest.raises(io.ContractError, match="paths fit"):
                io.resolve_one(f"{tmp_path}/a-*", session)


@pytest.mark.parametrize("args,want", [([], {"top_n": "5", "force": False}), (["--top-n=7"], {"top_n": "7", "force": False}), (["--force", "--top-n=a=b"], {"top_n": "a=b", "force": True}), (["--top-n="], {"top_n": "", "force": False}), (["--no=1"], None), (["top-n=1"], None)])
def test_parameters(args, want):
    if want is None:
        with pytest.raises(io.ContractError, match="unknown argument"):
            io.parameters(args, top_n="5", force=False)
    else:
        assert io.parameters(args, top_n="5", force=False) == want


@pytest.mark.parametrize("value", [None, "", "x"])
def test_required_input(value):
    if value:
        assert io.require_input("TOKEN", value) == value
    else:
        with pytest.raises(io.ContractError, match="TOKEN"):
            io.require_input("TOKEN", value)


CELLS = ['"', '""', ",", "a\nb", "a\r\nb", '\n"x', " lead and trail ", "\\", '\\"', "tab\t", "é, \U0001f600", "'", None, "#x", '","', "x" * 100_000]


def test_cells_come_back(spark, tmp_path):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(CELLS, reversed(CELLS)))]
    io.write_cells(spark.createDataFrame(rows, "id int, a string, b string").repartition(3), f"{tmp_path}/c")
    assert sorted(map(tuple, io.read_cells(spark, f"{tmp_path}/c", "id int, a string, b string").collect())) == rows
