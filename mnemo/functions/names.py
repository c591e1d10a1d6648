"""The name that a model's outputs bear: one rule for ledgers, reports and files."""

from __future__ import annotations

from collections.abc import Mapping

# The key that names the model in the configuration of each kind of back end
# whose names have '/' replaced.
NAME_KEYS = {"hf": "model_name", "sglang": "model_name", "foundry": "foundry_model_name"}


def model_name(config: Mapping) -> str:
    """The name of a configured model: the kind's own field with '/' replaced, else the
    deployment name as it is; ``unknown`` where the field is missing."""
    key = NAME_KEYS.get(config.get("model_type", "unknown"))
    return config.get(key, "unknown").replace("/", "_") if key else config.get("deployment_name", "unknown")


def output_name(model: str | Mapping) -> str:
    """The name in outputs of a model given by its configuration, or of a plain model name,
    which is one of a kind that has '/' replaced."""
    return model.replace("/", "_") if isinstance(model, str) else model_name(model)
