from fleetcatalog.operators.install import install_plan


def test_install_plan(spark):
    projects = spark.createDataFrame(
        [
            (2, "by-folder", "f2", True, True, "", True, "c2"),
            (1, "by.text", "f1", True, True, "x", False, "c1"),
            (3, "neither", "f3", True, True, "", False, "c3"),
            (4, "only-bundle", "f4", True, False, "x", True, "c4"),
            (5, "only-config", "f5", False, True, "x", True, "c5"),
        ],
        "ord int, name string, bundle_file string, has_bundle boolean, has_configuration boolean, "
        "config_text string, config_dir_exists boolean, config_file string",
    )
    fixed = spark.createDataFrame([(1, "store", "store")], "ord int, name string, bundle_name string")
    assert [tuple(r)[2:] for r in install_plan(projects, fixed).collect()] == [
        ("store", "store", None, "STORE_BUNDLE_ID"),
        ("by.text", "f1", "c1", "BY_TEXT_BUNDLE_ID"),
        ("by-folder", "f2", "c2", "BY_FOLDER_BUNDLE_ID"),
        ("neither", "f3", None, "NEITHER_BUNDLE_ID"),
    ]
    assert [r.name for r in install_plan(projects).collect()] == ["by.text", "by-folder", "neither"]
