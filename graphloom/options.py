"""Run options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """force_to_std_out wins over force_to_file, which wins over the plan's targets.

    working_dir_hint: where relative paths are looked up that don't exist as they are.
    deduplicate with dedup_scope ``statement`` drops repeated statements; ``record`` drops
    repeated blocks of statements of one row. on_invalid_iri: keep (as INVALID), drop (the
    statement) or fail. typed_literals writes datatypes and language tags of literals.
    multiline: whether quoted CSV fields hold line feeds; False lets large files be split.
    None looks for a line with an odd number of quotes first, and splits where there is none.
    message_buffer_capacity is accepted and means nothing here.
    """

    force_to_std_out: bool = False
    force_to_file: str | None = None
    working_dir_hint: str | None = None
    message_buffer_capacity: int = 128
    deduplicate: bool = False
    dedup_scope: str = "statement"
    escape_literals: bool = True
    on_invalid_iri: str = "keep"
    typed_literals: bool = False
    multiline: bool | None = None
    fuse_siblings: bool = True

    def __post_init__(self) -> None:
        if self.dedup_scope not in ("statement", "record"):
            raise ValueError("dedup_scope is statement or record")
        if self.on_invalid_iri not in ("keep", "drop", "fail"):
            raise ValueError("on_invalid_iri is keep, drop or fail")
