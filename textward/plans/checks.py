"""The checks of one deployment: the operators, with the settings of `sources.config` put in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.patterns import Registry
from textward.operators import capability, exfil, ingest, output
from textward.plans import turns
from textward.sources.config import Settings


@dataclass
class Checks:
    """Each method is an operator that takes what the settings say of it; options of a call come before them.

    keys is the source of the ring for `calls`. A canary is new for each object and stands in `prompt`.
    """

    settings: Settings = field(default_factory=Settings)
    keys: capability.Keys | None = None

    def __post_init__(self) -> None:
        s = self.settings
        self.registry = Registry.load(s.pattern_file, s.default_patterns)
        self.policy = exfil.Policy(allowed_hosts=frozenset(s.allowed_hosts))
        self.canary = output.Canary.generate() if s.canary else None
        self.prompt = self.canary.plant(s.system_prompt) if self.canary else s.system_prompt
        self.shadow = s.enforcement == "shadow"

    def inputs(self, df: DataFrame, *, principal: str | None = None, **options) -> DataFrame:
        """`turns.inputs`. Authenticated sessions belong to a principal, whose column has to be named."""
        if self.settings.session_identity == "authenticated" and principal is None:
            raise ValueError("sessions are authenticated: name the column of the principal, or set session_identity to anonymous")
        s = self.settings
        return turns.inputs(df, principal=principal, **dict(threshold=s.input_threshold, limits=s.limits, shadow=self.shadow, registry=self.registry, max_chars=s.max_scan_chars) | options)

    def answers(self, df: DataFrame, text_col: str = "text", **options) -> DataFrame:
        """`output.answer`, with the system prompt of the settings unless another column of prompts is named."""
        s = self.settings
        if "prompt_col" not in options and self.prompt is not None:
            df, options["prompt_col"] = df.withColumn("_prompt", F.lit(self.prompt)), "_prompt"
        given = dict(threshold=s.output_overlap, max_chars=s.max_scan_chars, registry=self.registry, policy=self.policy, shadow=self.shadow, urls=s.scan_output_urls, canaries=(self.canary,) if self.canary else ())
        return output.answer(df, text_col, **given | options).drop("_prompt")

    def ingested(self, df: DataFrame, **options) -> DataFrame:
        return ingest.verdicts(df, **dict(policy=self.policy, shadow=self.shadow, registry=self.registry, max_chars=self.settings.max_scan_chars) | options)

    def context(self, df: DataFrame, provenance: DataFrame, **options) -> DataFrame:
        s = self.settings
        return ingest.context(df, provenance, **dict(threshold=s.input_threshold, registry=self.registry, max_chars=s.max_scan_chars) | options)

    def calls(self, df: DataFrame, *, args_col: str = "arguments", result_col: str | None = None, **options) -> DataFrame:
        """`turns.authorized_calls` by the keys of now; scans of arguments and results can be set off."""
        if self.keys is None:
            raise ValueError("calls need a source of keys")
        s = self.settings
        given = dict(limits=s.limits, policy=self.policy, threshold=s.input_threshold, audience=s.audience, result_col=result_col if s.scan_tool_results else None)
        if not s.scan_tool_arguments:
            df, args_col = df.withColumn("_args", F.lit("{}")), "_args"
        return turns.authorized_calls(df, self.keys.ring, args_col=args_col, **given | options).drop("_args")
