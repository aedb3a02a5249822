"""The model queries run the operators with their defaults."""

import pytest
from rowkin.plans import models, queries


@pytest.mark.parametrize("name, operator", [("model_cheap_trim", "trimmed"), ("model_text_scorer", "text_scorer")])
def test_operator_defaults(spark, tmp_path, monkeypatch, name, operator):
    class Called(Exception):
        pass

    def called(*args, **named):
        assert not named and len(args) <= 1
        raise Called

    one = "select 1 as p_partkey, 'a b' as p_name, 'x' as p_type, 'Brand#1' as p_brand, 3 as p_size"
    spark.sql(one).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(models, operator, called)
    with pytest.raises(Called):
        queries.QUERIES[name](spark, str(tmp_path))
