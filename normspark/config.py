"""All parameters in one frozen object; run settings are variations of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from normspark import values as v


@dataclass(frozen=True)
class Config:
    """Corpus parameters and the switches of a run."""

    # corpus
    namespace: str = "http://example.org/ait-policy#"
    prefix: str = "ait"
    rule_prefix: str = "AIT"
    corpus_classes: tuple = v.CORPUS_CLASSES
    domain_words: tuple = v.DOMAIN_WORDS
    stop_words: tuple = v.STOP_WORDS + v.CORPUS_STOP_WORDS
    # run
    run: str = "baseline"
    use_prefilter: bool = True
    use_hints: bool = True
    use_second_opinion: bool = True
    use_direct_shapes: bool = True
    formula_retries: int = 2
    may_senses: bool = True
    # behaviour switches; the defaults give the classic results
    severity_by_confidence: bool = False
    severity_mode: str = "spec"  # or "inherit": results take the node shape's severity
    repair_second_opinion: bool = False

    @property
    def domain_words_longest_first(self) -> tuple:
        return tuple(sorted(self.domain_words, key=len, reverse=True))

    def iri(self, name: str) -> str:
        return self.namespace + name


# Names of the run settings and what each one switches.
RUN_SETTINGS = {
    "baseline": {},
    "no-prefilter": {"use_prefilter": False},
    "no-hints": {"use_hints": False},
    "no-reclassify": {"use_second_opinion": False},
    "no-fallback": {"use_direct_shapes": False},
    "no-fol-retry": {"formula_retries": 0},
    "no-may-disambig": {"may_senses": False},
}


def run_config(name: str, base: Config | None = None) -> Config:
    """The configuration of one named run; unknown names run like the baseline."""
    return replace(base or Config(), run=name, **RUN_SETTINGS.get(name, {}))


def output_name(source: str, run: str) -> str:
    """Folder or partition name of a run's output."""
    return source if run == "baseline" else f"{source}_{run}"
