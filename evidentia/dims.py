"""Word lists, lookup tables and formats that results depend on, as the file formats and tools define them."""

from __future__ import annotations

# --- fixed values: file type signatures (hex, offset, family, label); the first that matches wins
MAGIC = [
    ("4D5A", 0, "pe", "DOS/PE executable"),
    ("7F454C46", 0, "elf", "ELF executable"),
    ("255044462D", 0, "pdf", "PDF document"),
    ("D0CF11E0A1B11AE1", 0, "ole", "OLE2 compound document"),
    ("504B0304", 0, "zip", "ZIP container"),
    ("504B0506", 0, "zip", "ZIP container (empty)"),
    ("526172211A07", 0, "rar", "RAR archive"),
    ("377ABCAF271C", 0, "7z", "7-Zip archive"),
    ("1F8B", 0, "gzip", "gzip stream"),
    ("425A68", 0, "bzip2", "bzip2 archive"),
    ("FD377A585A", 0, "xz", "xz archive"),
    ("4D534346", 0, "cab", "Microsoft Cabinet"),
    ("4344303031", 0x8001, "iso", "ISO 9660 image"),
    ("4C00000001140200", 0, "lnk", "Windows shortcut (.lnk)"),
    ("CAFEBABE", 0, "class", "Java class"),
    ("7B5C727466", 0, "rtf", "Rich Text Format"),
    ("000100005374616E64617264204A6574204442", 0, "mdb", "Access database"),
]

# --- fixed values: extensions
SCRIPT_EXTS = {".js": "js", ".jse": "js", ".vbs": "vbs", ".vbe": "vbs", ".wsf": "wsf", ".wsh": "wsf", ".hta": "hta", ".ps1": "ps1", ".psm1": "ps1", ".bat": "bat", ".cmd": "bat", ".sh": "sh", ".py": "py", ".pl": "pl", ".rb": "rb", ".jar": "jar", ".lnk": "lnk"}
OFFICE_EXTS = [".doc", ".dot", ".docx", ".docm", ".dotm", ".xls", ".xlt", ".xlsx", ".xlsm", ".xltm", ".xlsb", ".ppt", ".pot", ".pptx", ".pptm", ".rtf", ".pub", ".mht", ".slk"]
ARCHIVE_EXTS = [".zip", ".rar", ".7z", ".gz", ".bz2", ".xz", ".tar", ".tgz", ".cab", ".iso", ".img", ".vhd", ".ace", ".arj", ".lzh"]
PE_EXTS = [".exe", ".dll", ".scr", ".com", ".sys", ".ocx", ".cpl", ".msi", ".pif"]
DANGEROUS_EXTS = sorted({*PE_EXTS, *SCRIPT_EXTS, ".msi", ".msp", ".reg", ".inf", ".chm", ".url"})
#: Extensions that a family may carry; other families are never a mismatch.
EXPECTED_EXTS = {
    "pe": PE_EXTS, "elf": [".elf", ".so", ".bin", ""], "pdf": [".pdf"], "ole_office": OFFICE_EXTS, "msg": [".msg"],
    "ooxml_word": [".docx", ".docm", ".dotm", ".dotx", ".doc"], "ooxml_excel": [".xlsx", ".xlsm", ".xltm", ".xlsb", ".xls"], "ooxml_powerpoint": [".pptx", ".pptm", ".ppt", ".potm"],
    "zip": ARCHIVE_EXTS, "rar": ARCHIVE_EXTS, "7z": ARCHIVE_EXTS, "gzip": ARCHIVE_EXTS, "cab": ARCHIVE_EXTS, "iso": ARCHIVE_EXTS,
}

# --- fixed values: script families by content, tried in this order on the first 4,096 bytes in lower case (Python, Java and RE2 read these alike)
SCRIPT_CONTENT = [
    ("js", r"<script|wscript\.|activexobject|new\s+activex"),
    ("vbs", r"createobject\s*\(|dim\s+\w+|wscript\.shell"),
    ("wsf", r"<job\b|<package\b"),
    ("ps1", r"invoke-expression|iex\s|\$env:|-encodedcommand|new-object\s+net\."),
    ("py", r"\A#![^\n]*python"),
    ("sh", r"\A#!"),
    ("bat", r"(?m)^\s*@echo\s+off|^\s*set\s+\w+="),
]

# --- fixed values: indicators
DOMAIN_TLDS = "com|net|org|info|biz|io|co|ru|cn|br|uk|de|fr|nl|eu|top|xyz|site|online|shop|club|live|icu|cc|tk|ml|ga|cf|gq|pw|su|link|click|zip|mov|app|dev|me|us|ca|au|in"
BENIGN_DOMAINS = ["schemas.openxmlformats.org", "schemas.microsoft.com", "www.w3.org", "purl.org", "schemas.xmlsoap.org", "openoffice.org", "www.openoffice.org", "sun.com", "docs.oasis-open.org", "ns.adobe.com", "www.adobe.com", "iso.org", "www.iso.org", "microsoft.com", "office.microsoft.com", "go.microsoft.com", "w3.org"]
BENIGN_IPS = ["0.0.0.0", "127.0.0.1", "255.255.255.255", "1.1.1.1", "8.8.8.8"]
ABUSED_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz", ".icu", ".click", ".zip", ".mov", ".su", ".pw", ".cc", ".live", ".shop"]
EXECUTABLE_URL_EXTS = [".exe", ".dll", ".scr", ".ps1", ".vbs", ".js", ".hta", ".bat", ".cmd", ".msi", ".jar", ".zip", ".7z", ".iso"]
ABUSE_KEYWORDS = ["ddos", "botnet", "c2", "cnc", "rat", "exploit", "malware", "trojan", "stealer", "loader", "dropper", "phish", "keylog", "ransom", "miner", "flood", "attack", "shell", "hack", "brute"]

# --- fixed values: VBA
AUTO_EXEC = ["autoopen", "auto_open", "autoclose", "auto_close", "autoexec", "auto_exec", "autonew", "document_open", "document_close", "documentopen", "workbook_open", "workbook_activate", "workbook_beforeclose", "app_workbookopen", "auto_activate"]
SUSPICIOUS_VBA = {
    "shell": "spawns a process",
    "wscript.shell": "instantiates the Windows Script Host shell",
    "createobject": "creates a COM object at runtime",
    "getobject": "binds to a COM object, often WMI",
    "powershell": "invokes PowerShell",
    "cmd.exe": "invokes the command interpreter",
    "winmgmts": "uses WMI, commonly Win32_Process.Create",
    "xmlhttp": "makes an HTTP request",
    "winhttprequest": "makes an HTTP request",
    "urldownloadtofile": "downloads a file from a URL",
    "adodb.stream": "writes downloaded bytes to disk",
    "savetofile": "writes a file to disk",
    "environ": "reads environment variables to locate a drop path",
    "chr(": "builds strings character-by-character to defeat string scanning",
    "chrw(": "builds strings character-by-character to defeat string scanning",
    "strreverse": "reverses strings to hide them",
    "base64": "decodes base64",
    "frombase64string": "decodes base64",
    "vbnormalnofocus": "launches a process with a hidden window",
    "windowstyle": "controls process window visibility, usually to hide it",
    "declare": "declares a Win32 API import from VBA",
    "virtualalloc": "allocates executable memory (shellcode injection)",
    "createthread": "starts a thread (shellcode injection)",
    "regwrite": "writes to the registry, often for persistence",
    "schtasks": "creates a scheduled task for persistence",
    "attributes.dll": "side-loads a DLL",
    "application.run": "dispatches to another macro at runtime",
    ".spawninstance_": "uses WMI to create a process",
    "mshta": "runs remote HTML applications",
    "regsvr32": "proxy-executes code via regsvr32",
    "rundll32": "proxy-executes code via rundll32",
    "certutil": "abuses certutil to download or decode payloads",
    "bitsadmin": "abuses BITS to download payloads",
}
SHELL_CALLS = ["shell", "wscript.shell", "powershell", "cmd.exe", "urldownloadtofile", "xmlhttp", "winhttprequest", "adodb.stream", "winmgmts", "mshta", "regsvr32", "rundll32", "certutil", "bitsadmin", "virtualalloc"]
HIDING_CALLS = ["chr(", "chrw(", "strreverse", "base64", "frombase64string"]

# --- fixed values: PowerShell
POWERSHELL_RISK = {
    "-enc": "runs a base64-encoded command",
    "-encodedcommand": "runs a base64-encoded command",
    "-w hidden": "hides the PowerShell window",
    "-windowstyle hidden": "hides the PowerShell window",
    "-nop": "skips the user profile so no logging hooks load",
    "-noprofile": "skips the user profile so no logging hooks load",
    "-ep bypass": "bypasses the execution policy",
    "-executionpolicy bypass": "bypasses the execution policy",
    "downloadstring": "downloads and runs code from a URL in memory",
    "downloadfile": "downloads a file to disk",
    "invoke-expression": "executes a string as code",
    "iex": "executes a string as code",
    "invoke-webrequest": "makes an HTTP request",
    "start-bitstransfer": "downloads over BITS to evade proxy logging",
    "frombase64string": "decodes a base64 payload",
    "system.reflection.assembly": "loads a .NET assembly in memory",
    "[reflection.assembly]::load": "loads a .NET assembly in memory",
    "add-mppreference": "adds a Defender exclusion",
    "set-mppreference": "weakens Defender settings",
    "new-object net.webclient": "creates a downloader",
    "gzipstream": "decompresses an in-memory payload",
    "virtualalloc": "allocates executable memory for shellcode",
    "-join": "reassembles a split string to defeat scanning",
}

# --- fixed values: PDF keywords
PDF_KEYWORDS = {
    "/JavaScript": "document carries JavaScript",
    "/JS": "document carries JavaScript",
    "/OpenAction": "an action runs automatically when the document is opened",
    "/AA": "an additional-action trigger is set (page open, field focus, ...)",
    "/Launch": "a /Launch action can start an external program",
    "/EmbeddedFile": "a file is embedded inside the PDF",
    "/Filespec": "a file specification is present (embedded or external file)",
    "/URI": "the document links out to a URL",
    "/SubmitForm": "the document can POST form data to a remote server",
    "/GoToR": "the document jumps into a remote document",
    "/RichMedia": "embedded Flash/rich media, a historic exploit vector",
    "/XFA": "XFA forms, which carry their own scriptable logic",
    "/AcroForm": "an interactive form is present",
    "/ObjStm": "objects are packed into compressed object streams (hides keywords)",
    "/Encrypt": "the document is encrypted",
}

# --- fixed values: imports and what they make a program capable of
IMPORT_CAPABILITIES = {
    "network": ["internetopen", "internetconnect", "httpsendrequest", "httpopenrequest", "urldownloadtofile", "winhttpopen", "winhttpconnect", "wsastartup", "connect", "send", "recv", "gethostbyname", "getaddrinfo", "socket", "dnsquery", "internetreadfile", "ftpputfile"],
    "process_injection": ["virtualallocex", "writeprocessmemory", "createremotethread", "ntunmapviewofsection", "setthreadcontext", "queueuserapc", "ntwritevirtualmemory", "rtlcreateuserthread", "openprocess", "zwunmapviewofsection", "mapviewofsection", "ntmapviewofsection"],
    "process_control": ["createprocess", "shellexecute", "winexec", "createthread", "terminateprocess", "openprocesstoken", "createprocessinternal"],
    "persistence": ["regcreatekey", "regsetvalue", "regopenkey", "createservice", "openscmanager", "startservice", "schtasks", "netscheduleadd"],
    "anti_analysis": ["isdebuggerpresent", "checkremotedebuggerpresent", "outputdebugstring", "ntqueryinformationprocess", "getickcount", "gettickcount", "queryperformancecounter", "sleep", "createtoolhelp32snapshot", "process32first", "process32next", "findwindow", "blockinput"],
    "credential_access": ["cryptunprotectdata", "credenumerate", "lsaretrieveprivatedata", "samconnect", "netuseradd", "wnetenumresource"],
    "keylogging": ["setwindowshookex", "getasynckeystate", "getkeystate", "getforegroundwindow", "registerrawinputdevices", "getrawinputdata"],
    "crypto": ["cryptencrypt", "cryptdecrypt", "cryptgenkey", "cryptacquirecontext", "bcryptencrypt", "cryptcreatehash", "cryptderivekey"],
    "dynamic_resolution": ["loadlibrary", "getprocaddress", "ldrloaddll", "ldrgetprocedureaddress"],
    "screen_capture": ["bitblt", "getdc", "createcompatiblebitmap", "printwindow"],
    "file_destruction": ["deletefile", "movefileex", "setfileattributes", "findfirstfile"],
}
PACKER_SECTIONS = {".aspack": "ASPack", ".adata": "ASPack", "upx0": "UPX", "upx1": "UPX", "upx2": "UPX", ".upx": "UPX", ".petite": "Petite", ".mpress1": "MPRESS", ".mpress2": "MPRESS", ".themida": "Themida", ".vmp0": "VMProtect", ".vmp1": "VMProtect", ".vmp2": "VMProtect", ".enigma1": "Enigma", ".enigma2": "Enigma", ".nsp0": "NsPack", ".packed": "generic packer", ".boom": "generic packer", ".ccg": "CCG", ".charmve": "PIN tool", ".taz": "PESpin", "pec1": "PECompact", "pec2": "PECompact", ".rlp": "RLPack", ".y0da": "yoda"}

# --- fixed values: traces
PERSISTENCE = [
    (r"/etc/(cron|systemd|init|rc\d?\.d|profile\.d)", "system-wide autostart"),
    (r"/\.config/(autostart|systemd)", "user autostart"),
    (r"/\.(bashrc|bash_profile|profile|zshrc|xinitrc)$", "shell startup file"),
    (r"/\.ssh/(authorized_keys|config)", "SSH access"),
    (r"(?i)\\\\(Start Menu|Startup)\\\\", "Windows Startup folder"),
    (r"(?i)(CurrentVersion\\\\Run|Software\\\\Microsoft\\\\Windows\\\\CurrentVersion)", "Windows Run key"),
    (r"(?i)/(appdata|roaming|localappdata|temp|tmp)/", "staging directory"),
]
LOLBIN = r"(?i)\b(powershell|pwsh|cmd\.exe|wscript|cscript|mshta|rundll32|regsvr32|certutil|bitsadmin|msiexec|installutil|schtasks|wmic|curl|wget|nc|ncat|socat|python[\d.]*|perl|ruby|php|bash|sh|base64|xxd|chmod|systemctl|crontab)\b"
NOISE_PREFIXES = ["/proc/", "/sys/", "/dev/null", "/dev/urandom", "/dev/random", "/dev/tty", "/usr/lib/", "/lib/", "/lib64/", "/etc/ld.so", "/usr/share/zoneinfo", "/usr/local/lib/python", "/usr/lib/python", "/etc/localtime", "/dev/pts"]
HARNESS = r"(?i)(wineserver|wineboot|winemenubuilder|winedevice|plugplay|services\.exe|explorer\.exe|svchost\.exe|rpcss|conhost\.exe|start\.exe|/usr/lib/wine/wine(64)?$)"
TRACE_LINES = 400_000

# --- fixed values: strace line shapes
EXECVE = r'execve\("([^"]*)",\s*\[(.*?)\](?:,\s*|\s*\))'
EXECVEAT = r'execveat\(\d+,\s*"([^"]*)",\s*\[(.*?)\]'
CONNECT = r'connect\(\d+(?:<[^>]*>)?,\s*\{sa_family=AF_INET6?,\s*sin6?_port=htons\((\d+)\),\s*sin6?_addr=inet_(?:pton|addr)\("?([^")]+)"?\)'
UNIX_CONNECT = r'connect\(\d+(?:<[^>]*>)?,\s*\{sa_family=AF_UNIX,\s*sun_path="([^"]*)"'
OPEN = r'openat?\((?:[^,]+,\s*)?"([^"]*)",\s*([A-Z_|0-9x]+)'
UNLINK = r'unlinkat?\((?:[^,]+,\s*)?"([^"]*)"'
CHMOD = r'f?chmodat?\((?:[^,]+,\s*)?"([^"]*)",\s*(\d+)'
RENAME = r'renameat2?\((?:[^,]+,\s*)?"([^"]*)",\s*(?:[^,]+,\s*)?"([^"]*)"'
MEMFD = r'memfd_create\("([^"]*)"'

# --- fixed values: words in class names of a JAR that are worth a note
JAR_KEYWORDS = ["exploit", "payload", "dropper", "shellcode", "loader", "injector", "backdoor", "trojan", "reverse", "meterpreter", "cobalt", "beacon", "keylog", "stealer", "dumper", "bypass", "obfusc", "crypter", "binder", "rat", "c2", "command", "invoke", "exec", "download", "upload"]

# --- fixed values: ELF object types
ELF_TYPES = {1: "REL", 2: "EXEC", 3: "DYN/PIE", 4: "CORE"}
