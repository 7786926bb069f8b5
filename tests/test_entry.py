import __spark_entry__


def test_only_what_is_absent_is_left_out():
    assert __spark_entry__.present("geoweft.plans") and not __spark_entry__.present("geoweft.nothing") and not __spark_entry__.present("no_such_module")
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and (not __spark_entry__.present("geoweft.llm") or "op1_shard" in names)
