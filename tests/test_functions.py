"""Pure functions: offsets, HTML, cleaning, headings, passages, service answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.errors import EmbeddingServiceError, EndpointConfigurationError
from passagemill.functions.chunking import WORDS, Sizes, Splitter
from passagemill.functions.cleaning import Cleaned
from passagemill.functions.headings import is_heading
from passagemill.functions.html_text import html_to_text
from passagemill.functions.offsets import OffsetMap, apply_changes
from passagemill.sources.embed import check_endpoint, unit_vectors


def one(offsets: OffsetMap, start: int, end: int):
    a, b = offsets.map([start], [end])
    return None if a[0] < 0 else (int(a[0]), int(b[0]))


def test_span_after_a_deletion():
    text, offsets = apply_changes("REMOVE ME keep this", [(0, 10, "")])
    a, b = one(offsets, 10, 14)
    assert text == "keep this" and text[a:b] == "keep"


def test_span_inside_a_removal_is_gone():
    _, offsets = apply_changes("abcDELETEDxyz", [(3, 10, "")])
    assert one(offsets, 4, 9) is None


def test_span_across_a_removal_keeps_the_rest():
    text, offsets = apply_changes("keep GONE tail", [(5, 10, "")])
    a, b = one(offsets, 0, 10)
    assert text[a:b] == "keep "


def test_several_changes():
    text, offsets = apply_changes("0123456789abcdefghij", [(2, 4, ""), (10, 12, "XX")])
    assert text == "01456789XXcdefghij"
    a, b = one(offsets, 14, 20)
    assert text[a:b] == "efghij"


def test_whole_source_survives():
    text, offsets = apply_changes("alpha beta", [(0, 5, "A")])
    assert one(offsets, 0, 10) == (0, len(text))


def test_overlapping_changes_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        apply_changes("abcdef", [(0, 4, ""), (2, 5, "")])


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=30), st.data())
def test_kept_characters_map_to_themselves(source, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(source)), max_size=6)))
    changes = [(a, b, "X") for a, b in zip(cuts[::2], cuts[1::2], strict=False) if a < b]
    text, offsets = apply_changes(source, changes)
    for k in range(len(source)):
        if not any(a <= k < b for a, b, _ in changes):
            a, b = one(offsets, k, k + 1)
            assert text[a:b] == source[k]


def test_html_spans_are_hulls_and_blanks_fold():
    text, spans = html_to_text('<div id="a"> x  <b id="b">y </b> z</div><p id="p-0">Hello <i>w</i>\r\n  there </p><p id="e"> </p>tail<img id="i">')
    assert text == "x y z\nHello w\nthere\ntail"
    assert spans == {"a": (0, 5), "b": (2, 4), "p-0": (6, 19)}


def naive_html(html):
    """Character by character, every character with its open ids."""
    from passagemill.functions.html_text import BLOCK_TAGS, VOID_TAGS, HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.chars, self.open = [], []

        def put(self, text):
            self.chars += [(c, {i for _, i in self.open if i}) for c in text]

        handle_data = put

        def handle_starttag(self, tag, attrs):
            self.put("\n" * (tag in BLOCK_TAGS))
            if tag not in VOID_TAGS:
                self.open.append((tag, dict(attrs).get("id")))

        def handle_startendtag(self, tag, attrs):
            self.put("\n" * (tag in BLOCK_TAGS))

        def handle_endtag(self, tag):
            self.put("\n" * (tag in BLOCK_TAGS))
            tags = [t for t, _ in self.open]
            if tag in tags:
                del self.open[len(tags) - 1 - tags[::-1].index(tag) :]

    p = P()
    p.feed(html)
    p.close()
    lines, line = [], []
    for c, ids in [*p.chars, ("\n", set())]:
        if c in "\r\n":
            lines.append(line)
            line = []
        elif c in " \t" and line and line[-1][0] == " ":
            line[-1] = (" ", line[-1][1] | ids)
        else:
            line.append((" " if c in " \t" else c, ids))
    out, spans = "", {}
    for line in lines:
        while line and line[0][0] == " ":
            line = line[1:]
        while line and line[-1][0] == " ":
            line = line[:-1]
        if line:
            out += "\n" if out else ""
            for c, ids in line:
                for i in ids:
                    a, b = spans.get(i, (len(out), len(out) + 1))
                    spans[i] = (min(a, len(out)), max(b, len(out) + 1))
                out += c
    return out, spans


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['<p id="a">', "</p>", '<b id="b">', "</b>", "<i>", "</i>", '<div id="a">', "</div>", "<br>", "x", " ", "  ", "\t", "\n", "\r\n", "&amp;", "yz"]), max_size=25))
def test_html_like_character_by_character(parts):
    assert html_to_text("".join(parts)) == naive_html("".join(parts))


def test_empty_elements_inside_a_word_have_no_span():
    assert html_to_text('a<b id="b"></b>c') == naive_html('a<b id="b"></b>c') == ("ac", {})


def test_cleaning_rules():
    cleaned = Cleaned("Veja www.exemplo.com aqui")
    assert cleaned.text == "Veja https://www.exemplo.com aqui"
    assert cleaned.map_spans([21], [25])[0][0] == cleaned.text.index("aqui")
    assert Cleaned("antes &lt;div class=&quot;x&quot;&gt;dentro&lt;/div&gt; depois").text == "antes dentro depois"
    assert Cleaned("assinado por <nome> em <data>").text == "assinado por <nome> em <data>"
    assert Cleaned("a b​c\u0007de�").text == "a bcd•e"
    assert Cleaned("HTTPS : // a.com/x").text == "https://a.com/x"
    prompt = Cleaned("Analise o documento e responda a pergunta.\nTexto")
    assert prompt.text == "Texto" and prompt.map_spans([0], [5])[0][0] == -1 and prompt.events[0][:2] == ("leading_prompt", 1)


@pytest.mark.parametrize("line", ["CARTÃO DE CRÉDITO", "I - DOS FATOS", "2.1. Da responsabilidade civil", "DAS ALEGAÇÕES DA PARTE AUTORA"])
def test_headings(line):
    assert is_heading(line)


@pytest.mark.parametrize("line", ["2.99.033", "13:59:01 Tribunal", "04/04/1976", "1.234,56", "", "F KO 4MQ33E", "2.1. 04/04/1976", "AB 1234567890 / 9876543210"])
def test_no_headings(line):
    assert not is_heading(line)


def by_characters(**more) -> Splitter:
    from passagemill.functions.headings import is_legacy_heading

    return Splitter(Sizes(**({"most": 64, "target": 48, "overlap": 8, "least": 8, "fold": False} | more)), len, is_legacy_heading)


def test_long_line_is_cut_into_overlapping_windows():
    text = " ".join(f"word{i}" for i in range(80))
    found = by_characters().split(text)
    assert len(found) > 1 and all(p.length <= 64 and text[p.start : p.end] == p.text for p in found)
    assert any(b.start < a.end for a, b in zip(found, found[1:], strict=False))


def test_sections_join_with_their_titles():
    found = by_characters(most=128, target=100).split("I – DOS FATOS\nFato curto.\nII – DO DIREITO\nFundamento curto.")
    assert [p.title for p in found] == ["I – DOS FATOS | II – DO DIREITO"]


def test_tables_repeat_their_header():
    rows = "\n".join(f"| {i} | {'x' * 20} |" for i in range(10))
    found = by_characters(most=100, target=80).split(f"| Item | Valor |\n| --- | --- |\n{rows}")
    assert len(found) > 1 and all(p.kind == "table" and p.text.startswith("| Item | Valor |\n| --- | --- |") and p.length <= 100 for p in found)


def test_header_only_table_respects_the_limit():
    found = Splitter(Sizes(20, 15, 8, 8, False)).split("| " + " ".join(f"value{i}" for i in range(80)) + " |")
    assert len(found) > 1 and all(p.kind == "table" and p.length <= 20 for p in found)


def test_short_tail_joins_its_table():
    text = "| Processo | Distribuição |\n| --- | --- |\n| 123 | 04/09/2025 |\nEmitida em: 12/09/2025"
    found = by_characters(most=128, target=100, least=30).split(text)
    assert [(p.kind, p.text) for p in found] == [("mixed", text)]


def test_page_separator_ends_a_region():
    found = by_characters(most=128, target=100).split("Primeiro documento.\nPÁGINA DE SEPARAÇÃO\nSegundo documento.")
    assert [p.text for p in found] == ["Primeiro documento.", "Segundo documento."]


def test_inconsistent_sizes_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        Sizes(target=10, overlap=10).check()
    assert WORDS.check()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Another one.", "I - DOS FATOS", "| a | b |", "| --- | --- |", "Evento 3", "x" * 30, "\n", " "]), max_size=60))
def test_passages_never_exceed_the_maximum(parts):
    for p in by_characters(fold=True).split("\n".join(parts)):
        assert p.length <= 64 and 0 <= p.start < p.end


GOOD = {"index": 0, "embedding": [1.0, 0.0]}


@pytest.mark.parametrize(
    "data, reason",
    [([GOOD], "1 results for 2"), ([GOOD, GOOD], "duplicate"), ([GOOD, GOOD | {"index": 2}], "indices"), ([GOOD, GOOD | {"index": "1"}], "index"), ([GOOD, {"index": 1, "embedding": [1.0]}], "1 dimensions"),
     ([GOOD, {"index": 1, "embedding": [float("nan"), 1]}], "finite"), ([GOOD, {"index": 1, "embedding": ["x", 1]}], "numeric"), ([GOOD, {"index": 1, "embedding": [True, 1]}], "numeric"),
     ([GOOD, {"index": 1, "embedding": [0.0, 0.0]}], "zero"), ([GOOD, {"index": 1}], "embedding"), ("nope", "data list")],
)
def test_unusable_answers(data, reason):
    with pytest.raises(EmbeddingServiceError, match=reason) as caught:
        unit_vectors({"data": data}, 2, 2)
    assert not caught.value.retryable


def test_answers_come_in_input_order_at_unit_length():
    found = unit_vectors({"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}, 2, 2)
    assert found.tolist() == [[pytest.approx(0.6), pytest.approx(0.8)], [0, 1]]


@pytest.mark.parametrize("url", ["http://example.com/v1", "https://u:p@example.com/v1", "ftp://example.com", "http://"])
def test_refused_endpoints(url):
    with pytest.raises(EndpointConfigurationError):
        check_endpoint(url)


def test_accepted_endpoints(monkeypatch):
    monkeypatch.setenv("EMBEDDING_TUNNEL_HOSTS", "gpu.local")
    for url in ("https://example.com/v1", "http://127.0.0.1:8000/v1", "http://gpu.local/v1"):
        assert check_endpoint(url) == url
    with pytest.raises(EndpointConfigurationError):
        check_endpoint("https://example.com/v1", verify_tls=False)
