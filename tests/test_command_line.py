import json

from lumenframe.__main__ import main


def told(capsys, *argv):
    code = main(["explain", *argv])
    return code, json.loads(capsys.readouterr().out)


def test_explain(capsys):
    code, row = told(capsys, "lumenframe.operators.text:clean_html", "string")
    assert (code, row["route"], row["operators"]) == (0, "native", ["regex"])
    code, row = told(capsys, "functions_under_test:affine", "double", "--returns", "double")
    assert (code, row["route"]) == (0, "native")
    code, row = told(capsys, "functions_under_test:rounded", "double", "--returns", "double")
    assert (code, row["route"], row["stage"]) == (1, "row", "capture")
    code, row = told(capsys, "functions_under_test:affine", "map<string,int>", "--returns", "double")
    assert (code, row["reason"]) == (1, "input_type")
