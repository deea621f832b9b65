"""Names, defaults and formats that results must agree on."""

# HTTP methods a route rule may name.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "TRACE", "CONNECT")

# A pattern led by a quoted literal that starts with a slash.
QUOTED_HEAD = r"^\\Q(/.*?)\\E.*\z"

# Protocol families of route rules.
FAMILIES = ("http", "tcp", "udp")

# Target platform versions, oldest first: their order is this order, not the text order.
TARGET_VERSIONS = ("1.1", "2.0")

# Target version of a bundle that names none, and the first that has access rules on by default.
DEFAULT_TARGET_VERSION = "2.0"
FIRST_VERSION_WITH_ACLS = "2.0"

# Newest target version that does not support access rules.
LAST_VERSION_WITHOUT_ACLS = "1.1"

# Manifest format version.
MANIFEST_VERSION = "1"

# Label and protocol of the endpoint every detected service set also gets.
REMOTING_LABEL = "akka-remote"
REMOTING_PROTOCOL = "tcp"

# Port used for services that are addressed by URI, and the marker on their paths.
DEFAULT_SERVICE_PORT = 9000
PRESERVE_PATH = "?preservePath"

# Bundle defaults.
DEFAULT_LABEL = "web"
DEFAULT_ROLES = ("web",)
DEFAULT_MIN_MEMORY_MIB = 384
DEFAULT_CHECK_DELAY_MS = 3000
DEFAULT_FILE_SYSTEM_TYPE = "universal"

# Web-service defaults.
WEB_CPUS = 0.1
WEB_HEAP_MIB = 128
WEB_MEMORY_MIB = 384
WEB_DISK_MB = 200

# Status check component of a manifest.
CHECK_LABEL = "bundle-status"
CHECK_DESCRIPTION = "Status check for the bundle component"
CHECK_COMMAND = ("check", "--initial-delay")

# Manifest fields that settings supply, with their types; the second group is per component.
HEADER_SETTINGS = {
    "name": "string",
    "compatibilityVersion": "string",
    "tags": "array<string>",
    "annotations": "string",
    "system": "string",
    "systemVersion": "string",
    "nrOfCpus": "double",
    "memory": "bigint",
    "diskSpace": "bigint",
    "roles": "array<string>",
}
COMPONENT_SETTINGS = {
    "description": "string",
    "file-system-type": "string",
    "start-command": "array<string>",
    "endpoints": (
        "map<string,struct<`bind-protocol`:string,`bind-port`:int,`service-name`:string,services:array<string>,"
        "acls:array<struct<http:struct<requests:array<struct<path:string,`path-beg`:string,`path-regex`:string,"
        "method:string,rewrite:string>>>,tcp:struct<requests:array<int>>,udp:struct<requests:array<int>>>>>>"
    ),
}
# Settings of the status check. Supplying only these makes no delta.
CHECK_SETTINGS = {"checks": "array<string>", "checkInitialDelay": "bigint"}

# Data lines read from a status report, after its header line.
REPORT_LINES = 10
