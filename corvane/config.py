"""Settings from the command line and the environment."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """``path``: folder of the vault. ``offline``: models are not fetched. ``embeddings``: are vectors made at all?"""

    path: str
    offline: bool = False
    embeddings: bool = True


def read_config(arguments: Sequence[str], environment: Mapping[str, str]) -> Config:
    """From ``--path`` (else sample_vault in the working folder), VAULT_OFFLINE=1 and VAULT_EMBEDDINGS=off."""
    parser = argparse.ArgumentParser(add_help=False)
    parser.add_argument("--path", default=os.path.join(os.getcwd(), "sample_vault"))
    known, _ = parser.parse_known_args(list(arguments))
    return Config(os.path.abspath(known.path), environment.get("VAULT_OFFLINE") == "1", environment.get("VAULT_EMBEDDINGS", "").lower() != "off")
