"""Errors of the recipe engine."""


class MillraceError(Exception):
    exit_code = 1


class RecipeError(MillraceError):
    """A recipe that can't be read."""

    exit_code = 2


class ValidationError(RecipeError):
    """A recipe that breaks rules."""


class PluginError(MillraceError):
    exit_code = 2


class ContractError(MillraceError):
    """An assertion of severity error failed."""


class MaterializeError(MillraceError):
    pass


class SinkCardinalityError(MaterializeError):
    """Paths of a sink repeat."""


class CacheError(MillraceError):
    pass


class SiblingMissing(CacheError):
    """No instance of the sibling recipe."""


class SiblingAmbiguous(CacheError):
    """Several instances of the sibling recipe."""


class SiblingWithoutStats(CacheError):
    """The sibling instance has no such fitted statistics."""
