"""Elements with text are judged by the model, whatever their tag."""

import pytest

from moodtide.llm import html_extraction

BEFORE, AFTER = "Words before it in a paragraph long enough to be kept by the model.", "Words after it in a paragraph long enough to be kept by the model."


@pytest.fixture(scope="module")
def model():
    return html_extraction.fit(html_extraction.labelled_pages(300))


def text_of(inside: str, model) -> str:
    return html_extraction.extract(f"<body><article><p>{BEFORE}</p><p>{inside}</p><p>{AFTER}</p></article></body>", model)


@pytest.mark.parametrize("tag", ["math", "object", "noscript", "canvas", "video", "audio", "iframe", "svg"])
def test_text_of_other_elements_stays(model, tag):
    said = "Fallback or formula text inside an article that is long enough to be read."
    assert text_of(f"<{tag}>{said}</{tag}>", model) == f"{BEFORE} {said} {AFTER}"
    assert text_of(f"<{tag}>", model).endswith(AFTER)


@pytest.mark.parametrize("tag", ["template", "textarea", "select"])
def test_left_out_elements(model, tag):
    assert text_of(f"<{tag}>gone</{tag}>", model) == f"{BEFORE} {AFTER}"
    assert text_of(f"<{tag}>", model) == f"{BEFORE} {AFTER}"


def test_scripts_run_to_the_end(model):
    assert text_of("<script>gone</script>", model) == f"{BEFORE} {AFTER}"
    assert text_of("<script>", model) == text_of("<style>", model) == BEFORE


def test_formulas_and_drawings(model):
    assert text_of("Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.", model) == f"{BEFORE} Let x=2 hold here. {AFTER}"
    assert text_of('Icon <svg class="logo"><path class="menu" d="M0"/><text>drawn</text></svg> stands here.', model).endswith(AFTER)
