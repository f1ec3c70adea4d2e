import pytest


@pytest.fixture
def orgs(spark):
    """Makes organizations from (id, name, source, source_id, region, from_date, record) with a loading time that rises with id."""
    from datetime import datetime, timedelta

    schema = "id bigint, name string, name_normalized string, source string, source_id string, region string, entity_type string, from_date string, to_date string, record map<string,string>, loaded_at timestamp"

    def make(rows):
        start = datetime(2021, 1, 1)
        full = [(i, n, None, s, k, r, "business", d, "", m, start + timedelta(days=i or 0)) for i, n, s, k, r, d, m in rows]
        return spark.createDataFrame(full, schema)

    return make
