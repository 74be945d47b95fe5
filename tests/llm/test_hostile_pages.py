"""Pages that cost time or room, and what shows and what doesn't."""

import time

import pytest

from claimloom.llm import htmltext, langid


@pytest.mark.parametrize(
    ("page", "least"),
    [
        ("<table><tr>" + "<td colspan=100 rowspan=65534>" * 100 + "</tr>" + "<tr><td>x</td></tr>" * 1000, 1000),
        ("<table><tr>" + "<td rowspan=60000>a" * 5000 + "</tr>" + "<tr><td>x" * 5000, 10_000),
        ("<table>" + "<tr><td colspan=100>" * 2000 + "<tr><td>y", 1),
        ("<table><tr><td>" + "w" * 200 + "</td>" + "<td>a</td>" * 900 + "</tr>" + "<tr><td></td>" * 3000 + "</table>", 900),
    ],
)
def test_tables_are_a_small_multiple_of_their_page(page, least):
    began = time.process_time()
    text = htmltext.render(page)[0]
    assert time.process_time() - began < 3
    assert least <= len(text) <= 12 * len(page)


def test_spans_end_with_their_rows():
    rows = [(0, [("a", 1, 9), ("b", 1, 1)]), (0, [("c", 1, 1)]), (1, [("d", 1, 1), ("e", 1, 1)])]
    assert htmltext.laid_out(rows) == ["a | b", "  | c", "d | e"]
    assert htmltext.laid_out([(0, [("|", 1, 1)]), (0, [("", 1, 1)])]) == ["|"]
    assert htmltext.laid_out([(0, [("long one", 2, 1), ("z", 1, 1)]), (0, [("x", 1, 1), ("y", 1, 1), ("w", 1, 1)])]) == ["long one | z", "x | y | w"]
    # all texts stay, whatever the grid
    wide = [(0, [(f"t{i}", 7, 3) for i in range(400)]) for _ in range(4)]
    assert sum(line.count("t399") for line in htmltext.laid_out(wide)) == 4


def test_selectors_and_media():
    def shows(style, body):
        return htmltext.render(f"<style>{style}</style>{body}")[0]

    assert shows(".Foo{display:none}", "<p class=foo>yes<p class=Foo>no") == "yes"
    assert shows("#A{display:none}P.x{display:none}", "<p id=a>yes<p id=A>no<p class=x>no") == "yes"
    assert shows("@media (max-width:1px){p{display:none}}", "<p>yes") == "yes"
    assert shows("@media print{p{display:none}}@media screen and (min-width:37em){.s{display:none}}", "<p>yes<p class=s>no") == "yes"
    assert shows("@media not print{.s{display:none}}@media (prefers-color-scheme:dark),(unheard:of){p{display:none}}", "<p>yes<p class=s>no") == "yes"
    assert shows(".a .b{display:none}", "<div class=a><i><b class=b>no</b></i>yes</div><b class=b>too</b>") == "yes\ntoo"
    assert shows("div > p{display:none}", "<div><p>no</p><section><p>yes</section></div>") == "yes"
    assert shows("body div p .c > i{display:none}", "<body><div><p><b class=c><i>no</i></b><b class=c><u><i>yes</i></u></b>") == "yes"
    # the more specific rule counts, then the later one; what isn't understood picks nothing
    assert shows("#k{display:block}.x{display:none}p{display:none}", "<p class=x id=k>yes<p>no") == "yes"
    assert shows("p{display:none}p{display:block}p:first-child,p[x],p + p,p ~ p,* + *{display:none}", "<p>yes<p x>yes") == "yes\n\nyes"
    assert shows(".a.b{display:none}", "<p class='b a'>no<p class=a>yes") == "yes"


def test_many_rules_and_deep_elements():
    names = "abcdefgh"
    sheet = "".join(f"{names[i % 8]} {names[i % 7]} {names[i % 5]} b c .x{i % 900}{{display:none}}" for i in range(3000))
    page = f"<style>{sheet}</style>" + "".join(f"<{n}>" for n in names) * 12 + "".join(f"<i class=x{i % 1000}>t</i>" for i in range(3000))
    began = time.process_time()
    htmltext.render(page)
    assert time.process_time() - began < 8


def test_what_is_closed_and_what_counts():
    assert htmltext.render("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>")[0] == "S\nT\nyes"
    assert htmltext.render("<dialog>no</dialog><dialog open>yes</dialog>")[0] == "yes"
    assert htmltext.render("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>")[0] == "kr"
    assert htmltext.render("<ol start=5><li>a<li value=9>b<li>c</ol>")[0] == "5. a\n9. b\n10. c"
    assert htmltext.render("<ol reversed><li>x<li>y</ol><ol start=junk><li>z</ol><ol start=-1><li>p<li>q</ol>")[0] == "2. x\n1. y\n\n1. z\n\n-1. p\n0. q"
    assert htmltext.render("<input value=go><button>ta</button><textarea>area</textarea>x")[0] == "go ta area x"


def test_declared_language_of_what_is_markup():
    assert langid.declared("<!-- <html lang='fr'> --><html lang='de-AT'>") == "de"
    assert langid.declared("<script>'<html lang=it>'</script><meta content='ES, en' http-equiv=Content-Language>") == "es"
    assert langid.declared("<html><meta http-equiv='content-language' content='nl'><html lang=pt>") == "nl"
    assert langid.declared("<HTML LANG=Fr><html lang=de>") == "fr"
    assert langid.declared("") == langid.declared("<p>no tags of that kind") == ""


@pytest.mark.parametrize("piece", ["<meta ", "<html ", "<html x='", "<!-- <html lang=de>", "<meta><html>"])
def test_declared_language_in_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    langid.declared(page)
    assert time.process_time() - began < 3
