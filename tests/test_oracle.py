"""Every registered query against its DuckDB oracle (sf0.001), and the entry smoke check."""

import pytest

from tests.conftest import SMALL


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["Hostname", "x", "Timestamp", "Series", "Value", "pos"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_match_oracle(spark):
    from tools.compare import compare
    res = compare(spark, SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    assert not bad, bad
    assert len(res) >= 90


SCAN_QUERIES = ["flagship_series", "q7_per_host_series", "q8a_last_30", "q8b_min_60", "q8c_mean_45", "q8e_frame_last_30",
                "q10_grouped_series", "q12_ordinal_x", "p3_hosts_in_order", "t15_option_lists", "o1_natural_sort_names",
                "o1_natural_sort_urls", "o2_natural_nohtml", "k1_append_keys", "e11_duplicate_row", "e3_new_lookup_values",
                "i2_line_scan", "i3_template_extract", "i3_template_no_eof", "i3_fillup", "i3_continue_list", "q10_grouped_positional",
                "q15_no_filter", "o1_natural_sort_numbers"]


def test_sliced_scan_path_matches_oracle(spark):
    """Many short slices at sf0.01 on every query that uses a keyed scan."""
    from tools.compare import compare
    from tests.conftest import SF, small_slices
    with small_slices(spark, 500):
        res = compare(spark, SF, SCAN_QUERIES, verbose=False)
    assert len(res) >= len(SCAN_QUERIES)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    assert not bad, bad
