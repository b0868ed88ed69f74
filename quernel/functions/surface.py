"""The functions a governed query may call, and how other dialects spell them."""

from __future__ import annotations

# Admitted functions by family, in Spark's spelling.
AGGREGATES = "array_agg avg bool_and bool_or collect_list corr count every listagg max mean min mode percentile_cont percentile_disc regr_slope some stddev stddev_samp string_agg sum"
DATETIME = "add_months current_date current_time current_timestamp date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth extract hour localtimestamp make_date minute month months_between now quarter second timestampdiff to_date to_timestamp year"
NULLS = "coalesce if ifnull nullif nvl"
NUMERIC = "abs ceil ceiling div exp floor greatest least ln log10 mod power pow round sign sqrt"
STRING = "btrim char_length character_length concat concat_ws initcap instr left length lower lpad ltrim position replace reverse right rpad rtrim split split_part startswith substr substring translate trim upper"
JSON = "get_json_object json_array_length named_struct parse_json struct to_json try_parse_json try_variant_get variant_get map_from_entries"
ARRAY = "array array_join array_remove cardinality element_at explode size sort_array"
WINDOW = "dense_rank first_value lag last_value lead nth_value ntile percent_rank rank row_number"
OPERATORS = "between in not and or cast try_cast like ilike isnull isnotnull case when to_char to_number"

FAMILIES = {"aggregate": AGGREGATES, "datetime": DATETIME, "null": NULLS, "numeric": NUMERIC, "string": STRING, "json": JSON, "array": ARRAY, "window": WINDOW, "operator": OPERATORS}
ALLOWED = frozenset(n for names in FAMILIES.values() for n in names.split())
# What is refused by name even where it looks harmless.
REFUSED = frozenset("rand randn random uuid shuffle monotonically_increasing_id input_file_name java_method reflect try_reflect session_user current_user user current_catalog current_database version md5 sha sha1 sha2 crc32 hash xxhash64 regexp regexp_like regexp_replace regexp_extract regexp_count rlike similar cume_dist grouping grouping_id spark_partition_id sleep clock_timestamp".split())

# Spellings of other dialects and Spark's own for them.
SPELLINGS = {
    "age": "timestampdiff", "char_length": "char_length", "json_agg": "to_json(collect_list(..))", "jsonb_agg": "to_json(collect_list(..))",
    "json_build_object": "to_json(named_struct(..))", "json_extract_path_text": "get_json_object", "json_object_agg": "to_json(map_from_entries(collect_list(struct(..))))",
    "log": "log10", "logical_and": "bool_and", "logical_or": "bool_or", "row_to_json": "to_json(struct(..))", "starts_with": "startswith",
    "localtime": "current_time", "statement_timestamp": "current_timestamp", "str_position": "position", "string_to_array": "split", "strpos": "instr", "time_to_str": "date_format",
    "transaction_timestamp": "current_timestamp", "unnest": "explode", "array_to_string": "array_join",
}


# Functions that Spark has under another name with the same arguments; and words that stand for a call.
RENAMED = {
    "array_to_string": "array_join", "logical_and": "bool_and", "logical_or": "bool_or", "starts_with": "startswith", "statement_timestamp": "current_timestamp",
    "strpos": "instr", "transaction_timestamp": "current_timestamp",
}
BARE = {"localtime": "current_time()", "localtimestamp": "localtimestamp()"}


def admitted(name: str) -> bool:
    low = name.lower()
    return low in ALLOWED and low not in REFUSED


def hint(name: str) -> str:
    """How Spark spells a function of another dialect; empty if there is nothing to say."""
    spelt = SPELLINGS.get(name.lower())
    return f"; write {spelt}" if spelt and spelt != name.lower() else ""


def listing() -> dict[str, list[str]]:
    """The admitted functions by family, as shown to whoever writes queries."""
    return {family: sorted(names.split()) for family, names in FAMILIES.items() if family != "operator"}
