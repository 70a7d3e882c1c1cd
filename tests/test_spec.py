"""S-04, S-05, P-20: metadata roles, parameter records, argument checks."""

import json

import pytest

from lacuna.spec import check_ratios, load_params, metadata_schema, pick_params, spec_from_metadata

META = {"tables": {"table": {"columns": {
    "Age": {"sdtype": "numerical", "computer_representation": "Int64"},
    "Occupation": {"sdtype": "categorical"},
    "Car.price": {"sdtype": "numerical"},
    "Note": {"sdtype": "text"},
    "product_item": {"sdtype": "categorical"}}}}}


def test_roles_keep_order_and_skip_target_and_other_types():
    s = spec_from_metadata(META)
    assert s.sparse == ("Occupation",) and s.dense == ("Age", "Car.price")
    assert s.features == ["Occupation", "Age", "Car.price"]


def test_metadata_schema_types():
    sch = {f.name: f.dataType.simpleString() for f in metadata_schema(META).fields}
    assert sch["Age"] == "bigint" and sch["Car.price"] == "double" and sch["Occupation"] == "bigint"


def test_params_missing_file_and_whitelist(tmp_path):
    assert load_params(tmp_path / "nope.json") == {}
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"C": 1.0, "n_neighbors": 5}))
    assert pick_params({"C": 10, "max_iter": 1000}, load_params(p), ["C", "max_iter"]) == {"C": 1.0, "max_iter": 1000}


def test_ratio_check():
    check_ratios(0.7, 0.1)
    with pytest.raises(ValueError):
        check_ratios(0.9, 0.1)
