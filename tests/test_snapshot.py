"""Snapshot outline and cleanup: whole outputs for own trees, three levels and deeper."""

from conftest import one

from condensa.operators import snapshot as SN


def outline(spark, *lines):
    text = "\n".join(lines)
    out = one(spark, SN.outline_expr("t"), t=text)
    return text if out is None else out


def cleanup(spark, *lines):
    text = "\n".join(lines)
    out = one(spark, SN.cleanup_expr("t"), t=text)
    return text if out is None else out


def test_heading_levels(spark):
    assert outline(spark, '- heading "Ndond whsti" [level=2] [ref=k4]') == "## Ndond whsti"
    assert outline(spark, '- heading "Thea" [level=9] [ref=k5]') == "###### Thea"
    # a level that is no number of ours does not end the job
    assert outline(spark, '- heading "Oner" [level=99999999999] [ref=k6]') == "# Oner"


def test_nested_inline_markup(spark):
    assert outline(spark, "- heading [level=2] [ref=k1]:", '  - link [ref=k2]:', "    - /url: /ere", "    - generic [ref=k3]:",
                   '      - strong [ref=k7]:', '        - text: Solved', "  - text: by hand") == "## [**Solved**](/ere) [k2] by hand"
    assert outline(spark, "- paragraph [ref=k1]:", "  - generic [ref=k2]:", "    - generic [ref=k3]:", '      - link "Shop" [ref=k4]:',
                   "        - /url: /shop", "      - strong [ref=k5]:", "        - generic [ref=k6]: open", "  - text: daily") \
        == "[Shop](/shop) [k4] **open** daily"


def test_unnamed_button_and_link(spark):
    assert outline(spark, "- button [ref=k1] [cursor=pointer]:", "  - generic [ref=k2]:", "    - generic [ref=k3]: Send it") == '[k1] button "Send it"'
    assert outline(spark, "- link [ref=k9] [cursor=pointer]:", "  - generic [ref=k8]:", '    - img "seal" [ref=k7]', "    - strong [ref=k6]: here",
                   "  - /url: /aa") == "[![seal] **here**](/aa) [k9]"


def test_states_and_placeholder(spark):
    assert outline(spark, '- button "Stop all" [disabled] [ref=k2]', '- textbox "Town" [ref=k3]:', "  - /placeholder: any town") == \
        '[k2] button "Stop all" (disabled)\n[k3] textbox "Town" — "any town"'


def test_lists_and_footer(spark):
    assert outline(spark, "- list [ref=k1]:", "  - listitem [ref=k2]:", '    - link "Atre" [ref=k3]:', "      - /url: /atre", "  - listitem [ref=k4]:",
                   "    - text: bare words", "- contentinfo [ref=k5]:", "  - paragraph [ref=k6]: small print") == "- [Atre](/atre) [k3]\n- bare words"


def test_rowgroups_at_any_depth(spark):
    got = outline(spark, "- table [ref=k1]:", "  - rowgroup [ref=k2]:", "    - rowgroup [ref=k3]:", '      - row "inner" [ref=k4]:',
                  '        - columnheader "Size" [ref=k5]', '        - columnheader [ref=k6]:', "          - generic [ref=k7]:", "            - strong [ref=k8]: Cost",
                  '      - row "i2" [ref=k9]:', '        - cell "4" [ref=k10]', '        - cell "buy" [ref=k11]:', '          - button "buy" [ref=k12]',
                  '    - row "outer" [ref=k13]:', '      - cell "last" [ref=k14]')
    assert got == "| Size | **Cost** |\n| --- | --- |\n| 4 | buy [k12] |\n| last |"


def test_fenced_tree_keeps_its_header(spark):
    got = outline(spark, "### State", "- Page URL: https://site7.example/x", "### Snapshot", "```yaml", "- generic [ref=k1]:",
                  "  - generic [ref=k2]:", '    - heading "Inner words" [level=1] [ref=k3]', "```")
    assert got == "### State\n- Page URL: https://site7.example/x\n### Snapshot\n\n# Inner words" or got.endswith("# Inner words")
    assert "```yaml" not in got and got.startswith("### State\n- Page URL: https://site7.example/x")


def test_longer_outline_keeps_the_original(spark):
    assert one(spark, SN.outline_expr("t"), t="ok") is None


def test_cleanup_keeps_refs_of_interactive_lines_only(spark):
    got = cleanup(spark, '- button "Hold" [ref=k1] [cursor=pointer]', '- paragraph [ref=k2]', '- heading "Up" [ref=k3]', '- combobox "Kind" [ref=k4]')
    assert got == '- button "Hold" [ref=k1]\n- paragraph\n- heading "Up"\n- combobox "Kind" [ref=k4]'


def test_cleanup_drops_footer_and_bare_images(spark):
    got = cleanup(spark, "- main:", '  - button "Y" [ref=k1]', "    - img", "", "", "", '  - heading "Z" [ref=k2]', "- contentinfo [ref=k3]:", '  - link "rules" [ref=k4]')
    assert "rules" not in got and "- img" not in got and "\n\n\n" not in got
    assert '- button "Y" [ref=k1]' in got and '- heading "Z"' in got
