"""What a file's name says: kind, category, why it isn't read, and which folders are skipped."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from findling.functions.paths import base_name, suffix

# Extensions by kind.
PROSE = """.txt .text .md .markdown .mdx .rst .org .adoc .asciidoc .textile .wiki .mediawiki .pod .rmd .qmd .csv .tsv .log
.html .htm .xhtml .tex .bib .ris .srt .vtt .ass .ssa .lrc .nfo .diz .asc .ics .vcf .po""".split()
CODE = """.json .jsonl .ndjson .geojson .yaml .yml .toml .ini .cfg .conf .properties .xml .xsd .xsl .xslt .plist .gpx .kml
.opml .rss .atom .xaml .resx .config .props .targets .csproj .vbproj .fsproj .vcxproj .sln .nuspec .reg .inf .graphql
.gql .proto .prisma
.py .pyw .pyi .pyx .ipynb .js .mjs .cjs .ts .tsx .mts .cts .jsx .coffee .java .kt .kts .groovy .gradle .scala
.sbt .clj .cljs .edn .c .h .cpp .hpp .cc .hh .cxx .hxx .ino .m .mm .cs .fs .fsi .fsx .vb .vbs .bas .frm .go .rs .zig .nim
.odin .d .rb .erb .php .pl .pm .swift .dart .lua .luau .r .jl .hs .lhs .elm .ml .mli .ex .exs .erl .hrl .gleam .rkt .scm
.lisp .el .pas .dpr .asm .s .f .f90 .f95 .for .cob .cbl .ada .adb .ads .v .sv .vhd .vhdl .tcl .awk .hx .sol .cu .cuh .glsl
.vert .frag .hlsl .wgsl .shader .gd .pde .sql .sh .bash .zsh .fish .ps1 .psm1 .psd1 .bat .cmd .ahk .au3 .nsi .iss .tf
.tfvars .hcl .nix .cmake .mk .mak .vim
.css .scss .sass .less .styl .vue .svelte .astro .jsp .asp .aspx .cshtml .razor .haml .slim .pug .hbs .mustache
.ejs .njk .jinja .j2 .twig .liquid .tpl""".split()
DOCUMENTS = """.pdf .rtf .docx .docm .dotx .dotm .xlsx .xlsm .xltx .xltm .pptx .pptm .ppsx .ppsm .potx .potm .doc .dot .xls
.xlt .ppt .pps .pot .odt .ott .fodt .ods .ots .fods .odp .otp .fodp .odg .otg .fodg .epub .eml .msg .mht .mhtml""".split()
RAW = ".cr2 .cr3 .crw .nef .nrw .arw .srf .sr2 .dng .orf .rw2 .raf .pef .srw .x3f .3fr .iiq .mrw .kdc .dcr .erf .mef .mos .rwl".split()
PICTURES = ".jpg .jpeg .jfif .jpe .png .apng .webp .avif .bmp .dib .gif .tif .tiff .heic .heif .psd .svg".split()
MEDIA = """.mp3 .wav .flac .m4a .aac .ogg .oga .opus .wma .aiff .aif .mid .midi .amr .ape .mka .mp4 .m4v .mkv .avi .mov .wmv
.webm .flv .mpg .mpeg .m2ts .mts .3gp .vob .ogv .asf .rm .rmvb""".split()
PROGRAMS = """.exe .dll .msi .msix .msixbundle .appx .appxbundle .sys .drv .ocx .cpl .scr .com .efi .mui .msp .lib .a .o .obj
.pdb .pyd .pyc .so .dylib .class .jar .war .apk .aab .ipa .deb .rpm .nupkg .whl .crx .xpi .lnk .url .ttf .otf .ttc .woff
.woff2 .fon .eot .vhd .vhdx .vmdk .img .dmg .bin .dat .tmp .cache .db .sqlite .sqlite3 .mdb .accdb .ldf .mdf .dmp .etl
.evtx .ldb .db-journal .db-wal .db-shm .sqlite3-journal .pfx .p12 .cer .crt .der .pem .key""".split()
MAILBOXES = ".pst .ost .nst .olm .mbox".split()
BACKUPS = ".bak .old .orig".split()
MAILS = ".eml .msg .mht .mhtml".split()
MAIL_CONTAINERS = [".eml", ".msg"]
ZIPS, TARS = [".zip"], ".tar .tgz .tbz .tbz2 .txz".split()
SINGLES, LIBRARIES = ".gz .bz2 .xz".split(), ".7z .rar .cab .iso .lzh .lha .zipx .xar .tzst".split()
KNOWN_TEXT = "readme license licence copying notice changelog changes authors contributors todo".split()
KNOWN_CODE = "makefile dockerfile containerfile jenkinsfile vagrantfile gemfile rakefile procfile justfile".split()
PROGRAM_FOLDERS = [
    "node_modules", "__pycache__", ".git", ".svn", ".hg", ".venv", "venv", "env", "site-packages", ".cache", ".idea", ".vscode",
    "$recycle.bin", "system volume information", "appdata", "target", ".next", ".nuxt", "dist", "build",
]
SYSTEM_FOLDERS = ["$recycle.bin", "system volume information"]
CATEGORIES = ("documents", "pictures", "text", "mail", "archives")
MEGABYTE = 1024 * 1024
LIMITS = {"text": 5 * MEGABYTE, "doc": 200 * MEGABYTE, "image": 80 * MEGABYTE, "raw": 300 * MEGABYTE}

#: Extension -> kind; where two lists name one, pictures win over documents, these over code, that over prose.
KINDS = {**dict.fromkeys(PROSE, "text"), **dict.fromkeys(CODE, "code"), **dict.fromkeys(DOCUMENTS, "doc"), **dict.fromkeys(PICTURES + RAW, "image")}
REASONS = {**dict.fromkeys(MAILBOXES, "mailbox"), **dict.fromkeys(PROGRAMS, "program"), **dict.fromkeys(MEDIA, "media")}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def kind_of(name: Column) -> Column:
    """image, doc, code or text by the name; null if it doesn't say."""
    ext, base = suffix(name), F.lower(base_name(name))
    return F.when(ext != "", _lookup(KINDS, ext)).otherwise(_lookup({**dict.fromkeys(KNOWN_TEXT, "text"), **dict.fromkeys(KNOWN_CODE, "code")}, base))


def why_not(name: Column) -> Column:
    return F.coalesce(_lookup(REASONS, suffix(name)), F.lit("type"))


def category(kind: Column, name: Column) -> Column:
    return F.when(suffix(name).isin(*MAILS), "mail").when(kind == "image", "pictures").when(kind.isin("text", "code"), "text").otherwise("documents")


def container_type(name: Column) -> Column:
    """zip, tar, single, library or mail; null for plain files."""
    low, ext = F.lower(base_name(name)), suffix(name)
    return (
        F.when(low.rlike(r"\.tar\.(gz|bz2|xz)$"), "tar").when(low.rlike(r"\.tar\.zst$"), "library").when(ext.isin(*ZIPS), "zip")
        .when(ext.isin(*TARS), "tar").when(ext.isin(*SINGLES), "single").when(ext.isin(*LIBRARIES), "library").when(ext.isin(*MAIL_CONTAINERS), "mail")
    )


def format_key(ext: Column) -> Column:
    """An extension as settings keep it: a dot and up to 15 ASCII letters or digits; null if it isn't one."""
    e = F.lower(F.regexp_replace(F.trim(ext), r"^\.+", ""))
    return F.when(e.rlike("^[a-z0-9]{1,15}$"), F.concat(F.lit("."), e))


def looks_inside(name: Column, off: tuple[str, ...] = (), formats_off: tuple[str, ...] = ()) -> Column:
    kind = container_type(name)
    on = F.when(kind == "mail", F.lit("mail" not in off)).otherwise(F.lit("archives" not in off))
    return F.when(kind.isNull() | suffix(name).isin(*formats_off, "?"), False).otherwise(on)


def decide(name: Column, off: tuple[str, ...] = (), formats_off: tuple[str, ...] = ()) -> Column:
    """The kind a file is read as, or why it isn't: off, archive, media, program, mailbox, type."""
    kind = kind_of(name)
    is_off = category(kind, name).isin(*off, "?") | suffix(name).isin(*formats_off, "?")
    return (
        F.when(kind.isNotNull(), F.when(is_off, "off").otherwise(kind))
        .when(container_type(name).isNotNull(), F.when(looks_inside(name, off, formats_off), "archive").otherwise("off"))
        .otherwise(why_not(name))
    )


def max_bytes(kind: Column, name: Column) -> Column:
    ext = suffix(name)
    return (
        F.when((kind == "image") & (ext.isin(*RAW) | ~ext.isin(*PICTURES, *RAW)), LIMITS["raw"])
        .when(kind == "image", LIMITS["image"]).when(kind == "doc", LIMITS["doc"]).otherwise(LIMITS["text"])
    )


def skip_dir(name: Column, parent: Column, hidden: Column | None = None, system: Column | None = None, program_folders: bool = False, hidden_files: bool = False) -> Column:
    """Why a folder isn't looked into (hidden, program_folder), or null."""
    low, no = F.lower(name), F.lit(False)
    hidden, system = no if hidden is None else hidden, no if system is None else system
    program = low.isin(*PROGRAM_FOLDERS) | ((F.lower(parent) == "android") & low.isin("data", "obb"))
    return (
        F.when(system | low.isin(*SYSTEM_FOLDERS), "hidden").when(program & F.lit(not program_folders), "program_folder")
        .when((hidden | F.startswith(name, F.lit("."))) & F.lit(not hidden_files), "hidden")
    )


def skip_file(name: Column, hidden: Column | None = None, system: Column | None = None, hidden_files: bool = False) -> Column:
    """Why a file isn't searched whatever its type (office_temp, hidden, backup), or null."""
    no = F.lit(False)
    hidden, system = no if hidden is None else hidden, no if system is None else system
    return (
        F.when(F.startswith(name, F.lit("~$")), "office_temp").when(system, "hidden")
        .when((hidden | F.startswith(name, F.lit("."))) & F.lit(not hidden_files), "hidden")
        .when(F.endswith(name, F.lit("~")) | suffix(name).isin(*BACKUPS), "backup")
    )


def skip_path(parts: Column) -> Column:
    """The first reason to skip that the folders above a file, or its name, give; parts is the split path below the root."""
    n = F.size(parts)
    reasons = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.when(i < n, skip_dir(F.element_at(parts, i), F.when(i > 1, F.element_at(parts, F.greatest(i - 1, F.lit(1)))).otherwise(""))),
    )
    return F.coalesce(F.element_at(F.concat(F.filter(reasons, lambda r: r.isNotNull()), F.array(F.lit(None).cast("string"))), 1), skip_file(F.element_at(parts, -1)))
