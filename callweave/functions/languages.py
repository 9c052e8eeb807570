"""Dialects, the name sets that steer extraction and resolution, and the discovery defaults."""

from __future__ import annotations

#: File extension -> dialect.
EXTENSIONS = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx",
    ".php": "php",
    ".rb": "ruby", ".rake": "ruby",
    ".go": "go",
}
LANGUAGES = ("python", "javascript", "typescript", "tsx", "php", "ruby", "go")
#: Dialects that import each other resolve as one family.
JS_FAMILY = ("javascript", "typescript", "tsx")
JSX_LANGUAGES = ("javascript", "tsx")

#: Receivers, and the families in which a rule of resolution holds.
SELF_RECEIVERS = ("self", "this", "$this", "static")
SUPER_RECEIVERS = ("super", "parent")
BARE_CALL_HITS_CLASS = ("python", "js", "go")
LOCALS_MASK_FUNCTIONS = ("python", "js", "go", "ruby")

#: Call names of string dispatch in PHP.
PHP_LISTEN = ("add_action", "add_filter")
PHP_FIRE = ("do_action", "do_action_ref_array", "apply_filters", "apply_filters_ref_array")
PHP_REST = ("register_rest_route",)
#: Names of signal, task and route dispatch in Python.
PY_CONNECT = ("connect",)
PY_SEND = ("send", "send_robust")
PY_RECEIVER_DECORATORS = ("receiver",)
PY_TASK_DECORATORS = ("task", "shared_task")
PY_TASK_FIRE = ("delay", "apply_async")
PY_ROUTE_DECORATORS = ("route", "get", "post", "put", "delete", "patch", "websocket")
PY_ROUTE_CALLS = ("path", "re_path", "url")
RUBY_MIXINS = ("include", "extend", "prepend")
#: Signals that exist without a definition in the tree.
BUILTIN_SIGNALS = (
    "pre_init", "post_init", "pre_save", "post_save", "pre_delete", "post_delete", "m2m_changed", "pre_migrate", "post_migrate",
    "class_prepared", "request_started", "request_finished", "got_request_exception", "setting_changed", "connection_created",
    "user_logged_in", "user_logged_out", "user_login_failed",
)

#: Limits of ingestion.
MAX_FILE_BYTES = 1_500_000
MINIFIED_BYTES, MINIFIED_PER_LINE = 200_000, 5_000
SUGGEST_SCOPE_ABOVE = 1_500
#: Limits of the tools.
MAX_DEPTH, MAX_TOP, BETWEENNESS_NODES = 25, 1_000, 1_500
SHADOW_CALLS, SHADOW_SHARE = 100, 0.03
