"""Model clients and the context service, with stand-ins for what answers."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import ModuleType, SimpleNamespace

import pytest

from inkveil.errors import ContextUnavailable, MissingDependency, ProviderFailure
from inkveil.operators.prompts import TEXT_SCHEMA
from inkveil.options import RedactOptions
from inkveil.plans.pipeline import file_pages
from inkveil.providers import AnthropicProvider, OpenAIProvider
from inkveil.sources import files

REQUEST = {"system": "s", "prompt": "p", "images": [b"png"], "schema": TEXT_SCHEMA, "max_tokens": 7}


def client(monkeypatch, package, maker, answer):
    """A stand-in module whose client keeps what it is asked and answers with answer()."""
    asked = []

    def create(**request):
        asked.append(request)
        return answer()

    ways = SimpleNamespace(create=create)
    module = ModuleType(package)
    setattr(module, maker, lambda **options: asked.append(options) or SimpleNamespace(chat=SimpleNamespace(completions=ways), messages=ways))
    monkeypatch.setitem(sys.modules, package, module)
    return asked


def test_chat_completions(monkeypatch):
    said = ['{"redactions": []}']
    asked = client(monkeypatch, "openai", "OpenAI", lambda: SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=said[0]))]))
    own = OpenAIProvider("m", base_url="http://host", image_detail="low")
    assert own.generate(REQUEST) == {"redactions": []} and own.name == "openai:m"
    options, request = asked
    assert options == {"base_url": "http://host"} and (request["model"], request["max_completion_tokens"]) == ("m", 7)
    assert request["messages"][0] == {"role": "system", "content": "s"}
    text, image = request["messages"][1]["content"]
    assert text["text"] == "p" and image["image_url"] == {"url": "data:image/png;base64,cG5n", "detail": "low"}
    form = request["response_format"]["json_schema"]
    assert form["strict"] and form["schema"]["additionalProperties"] is False and form["name"] == TEXT_SCHEMA["name"]
    own.generate(REQUEST)
    assert len(asked) == 3  # one client for both
    for said[0], why in (("", "no content"), (None, "no content"), ("not json", "no JSON")):
        with pytest.raises(ProviderFailure, match=why):
            own.generate(REQUEST)


def test_messages(monkeypatch):
    reply = SimpleNamespace(stop_reason="end_turn", content=[SimpleNamespace(type="thinking"), SimpleNamespace(type="text", text='{"a":'), SimpleNamespace(type="text", text=" 1}")])
    asked = client(monkeypatch, "anthropic", "Anthropic", lambda: reply)
    own = AnthropicProvider("m", effort="low")
    assert own.generate(REQUEST) == {"a": 1}
    request = asked[1]
    assert request["output_config"] == {"format": {"type": "json_schema", "schema": TEXT_SCHEMA["schema"]}, "effort": "low"} and request["system"] == "s"
    assert [p["type"] for p in request["messages"][0]["content"]] == ["image", "text"]
    reply.stop_reason = "refusal"
    with pytest.raises(ProviderFailure, match="declined"):
        own.generate(REQUEST)


def test_a_client_that_is_not_installed(monkeypatch):
    monkeypatch.setitem(sys.modules, "openai", None)
    with pytest.raises(MissingDependency, match="openai"):
        OpenAIProvider().generate(REQUEST)


class Parser(BaseHTTPRequestHandler):
    """Answers by what it is sent."""

    def do_PUT(self):
        sent = self.rfile.read(int(self.headers["Content-Length"]))
        code, body = {b"%PDF-empty": (422, b"no text here"), b"%PDF-broken": (500, b"x" * 900), b"%PDF-blank": (200, b"  \n")}.get(sent, (200, b"# Title\n" + self.path.encode()))
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def parser():
    server = HTTPServer(("127.0.0.1", 0), Parser)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/any/path"
    server.shutdown()


def test_context_service(spark, parser, tmp_path):
    assert files.fetch_context(parser, b"%PDF-x") == "# Title\n/tika"
    for sent, code in ((b"%PDF-empty", "CONTEXT_NO_TEXT"), (b"%PDF-broken", "CONTEXT_FAILED")):
        with pytest.raises(ContextUnavailable) as failed:
            files.fetch_context(parser, sent)
        assert failed.value.code == code
    with pytest.raises(ContextUnavailable):
        files.fetch_context("http://127.0.0.1:1", b"x", timeout=2)
    for name in ("x", "empty", "broken", "blank"):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF-" + name.encode())
    read = files.read_files(spark, str(tmp_path))
    got = {r["doc_id"].split("/")[-1]: (r["markdown"], r["warning"]) for r in files.context_table(read, parser).collect()}
    assert got["x.pdf"] == ("# Title\n/tika", None) and got["blank.pdf"] == (None, None)
    assert all(got[k][0] is None and "continued without it" in got[k][1] for k in ("empty.pdf", "broken.pdf"))
    source = file_pages(read, RedactOptions(("email",), context_url=parser, ocr=False))
    assert [json.loads(json.dumps(r["markdown"])) for r in source.context.collect()] == ["# Title\n/tika"]
    assert sum("continued without it" in r["warning"] for r in source.warnings.collect()) == 2
