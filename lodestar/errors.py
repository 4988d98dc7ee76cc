"""Errors with a stable code."""


class LodestarError(Exception):
    code = "INTERNAL"


class InvalidArgument(LodestarError):
    code = "INVALID_ARGUMENT"


class NotFound(LodestarError):
    code = "NOT_FOUND"


class AlreadyExists(LodestarError):
    code = "ALREADY_EXISTS"


class FailedPrecondition(LodestarError):
    code = "FAILED_PRECONDITION"


class Unavailable(LodestarError):
    code = "UNAVAILABLE"
