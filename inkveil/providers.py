"""Models behind a small protocol, called from executors one request at a time or played back from a list or table."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.errors import MissingDependency, ProviderFailure


class Provider(Protocol):
    """A request is a dict: system, prompt, images (PNG bytes), schema, max_tokens. The answer is the parsed JSON."""

    name: str
    supports_vision: bool

    def generate(self, request: dict) -> Any: ...


class CustomProvider:
    """Any function from a request to JSON: a gateway, a queue, a model of one's own."""

    def __init__(self, name: str, generate: Callable[[dict], Any], supports_vision: bool = False):
        self.name, self.supports_vision, self.generate = name, supports_vision, generate


class ScriptedProvider:
    """Plays answers in order and remembers the requests; asks for more answers than there are fail."""

    def __init__(self, answers: list[Any], name: str = "scripted", supports_vision: bool = True):
        self.name, self.supports_vision, self.answers, self.requests = name, supports_vision, list(answers), []

    def generate(self, request: dict) -> Any:
        self.requests.append(request)
        if len(self.requests) > len(self.answers):
            raise ProviderFailure(f"no answer left after {len(self.answers)} calls; add one for each call", self.name)
        return self.answers[len(self.requests) - 1]


class _SdkProvider:
    """Adapters build their client in the process that calls, once."""

    package = ""

    def __init__(self, model: str, supports_vision: bool = True, **client: Any):
        self.model, self.supports_vision, self.client_options, self._client = model, supports_vision, client, None
        self.name = f"{self.package}:{model}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def client(self, maker: str) -> Any:
        if self._client is None:
            try:
                module = __import__(self.package)
            except ImportError as e:
                raise MissingDependency(self.package, f"use the {self.package} provider") from e
            self._client = getattr(module, maker)(**self.client_options)
        return self._client

    def parsed(self, text: str | None) -> Any:
        if not (text or "").strip():
            raise ProviderFailure(f"{self.name} returned no content", self.name)
        try:
            return json.loads(text)
        except ValueError as e:
            raise ProviderFailure(f"{self.name}: the reply is no JSON: {text[:200]}", self.name) from e


class OpenAIProvider(_SdkProvider):
    """Chat completions with a strict schema; base_url reaches whatever speaks the same protocol."""

    package = "openai"

    def __init__(self, model: str = "gpt-4.1", image_detail: str = "high", supports_vision: bool = True, **client: Any):
        super().__init__(model, supports_vision, **client)
        self.image_detail = image_detail

    def generate(self, request: dict) -> Any:
        parts: list[dict] = [{"type": "text", "text": request["prompt"]}]
        for png in request.get("images") or ():
            parts.append({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(png).decode(), "detail": self.image_detail}})
        schema = request["schema"]
        reply = self.client("OpenAI").chat.completions.create(
            model=self.model,
            max_completion_tokens=request["max_tokens"],
            messages=[{"role": "system", "content": request["system"]}, {"role": "user", "content": parts}],
            response_format={"type": "json_schema", "json_schema": schema | {"schema": strict_schema(schema["schema"]), "strict": True}},
        )
        return self.parsed(reply.choices[0].message.content if reply.choices else None)


class AnthropicProvider(_SdkProvider):
    """Messages with a JSON schema for the output; a refusal is a failure, as the result would be incomplete."""

    package = "anthropic"

    def __init__(self, model: str, effort: str | None = None, **client: Any):
        super().__init__(model, True, **client)
        self.effort = effort

    def generate(self, request: dict) -> Any:
        images = [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": base64.b64encode(png).decode()}} for png in request.get("images") or ()]
        output = {"format": {"type": "json_schema", "schema": request["schema"]["schema"]}} | ({"effort": self.effort} if self.effort else {})
        reply = self.client("Anthropic").messages.create(
            model=self.model,
            max_tokens=request["max_tokens"],
            system=request["system"],
            messages=[{"role": "user", "content": [*images, {"type": "text", "text": request["prompt"]}]}],
            output_config=output,
        )
        if reply.stop_reason == "refusal":
            raise ProviderFailure("the model declined the request; the result would be incomplete", self.name)
        return self.parsed("".join(b.text for b in reply.content if b.type == "text"))


# Schema keywords that the strict dialect rejects.
NOT_STRICT = {
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern",
    "format", "minItems", "maxItems", "uniqueItems", "default", "examples", "oneOf", "not", "if", "then", "else", "patternProperties",
}


def strict_schema(schema: Any) -> Any:
    """A JSON schema in the strict dialect: rejected keywords gone, every property required, optional ones nullable.

    Names of properties are not keywords and stay, whatever they are.
    """
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: ({n: strict_schema(s) for n, s in v.items()} if k == "properties" and isinstance(v, dict) else strict_schema(v)) for k, v in schema.items() if k not in NOT_STRICT}
    if out.get("type") == "object" and isinstance(out.get("properties"), dict):
        needed = schema.get("required") if isinstance(schema.get("required"), list) else []
        for name, own in out["properties"].items():
            if name not in needed and isinstance(own, dict) and (kinds := own.get("type")):
                kinds = kinds if isinstance(kinds, list) else [kinds]
                if kinds != ["null"]:
                    own["type"] = kinds if "null" in kinds else [*kinds, "null"]
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def ask(requests: DataFrame, provider: Provider, system: str, schema: dict, max_tokens: int, at_once: int, images: bool = False) -> DataFrame:
    """requests with ``reply`` as JSON. at_once bounds the calls in flight. Write the result before using it: calls are not repeatable."""
    if images and not provider.supports_vision:
        raise ProviderFailure(f"{provider.name} cannot read images", provider.name)
    columns = [F.col(c) for c in requests.columns]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pngs = batch.column("image").to_pylist() if images else [None] * batch.num_rows
            replies = []
            for prompt, png in zip(batch.column("prompt").to_pylist(), pngs, strict=True):
                try:
                    got = provider.generate({"system": system, "prompt": prompt, "images": [png] if png else [], "schema": schema, "max_tokens": max_tokens})
                except (ProviderFailure, MissingDependency):
                    raise
                except Exception as e:
                    raise ProviderFailure(f"{provider.name}: {e}", provider.name) from e
                replies.append(json.dumps(got))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, "reply"])

    from pyspark.sql import types as T

    schema_out = T.StructType([*requests.schema.fields, T.StructField("reply", T.StringType())])
    return requests.select(*columns).repartition(at_once).mapInArrow(told, schema_out)


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests with replies recorded by (doc_id, call). A request without one fails when it is read."""
    met = requests.join(recorded.select("doc_id", "call", F.col("reply").alias("_reply")), ["doc_id", "call"], "left")
    missing = F.raise_error(F.format_string("no recorded reply for document %s, call %d", F.col("doc_id").cast("string"), "call"))
    return met.withColumn("reply", F.coalesce("_reply", missing.cast("string"))).drop("_reply")
