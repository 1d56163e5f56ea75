from html.entities import name2codepoint
"""Fixed word lists. They are values, not logic; results depend on every entry."""

# Attribute names kept on article elements.
ALLOWED_ATTRIBUTES = tuple(
    """
    content alt id title src href about accesskey
    aria-activedescendant aria-atomic aria-autocomplete aria-busy aria-checked aria-controls
    aria-describedat aria-describedby aria-disabled aria-dropeffect aria-expanded aria-flowto
    aria-grabbed aria-haspopup aria-hidden aria-invalid aria-label aria-labelledby aria-level
    aria-live aria-multiline aria-multiselectable aria-orientation aria-owns aria-posinset
    aria-pressed aria-readonly aria-relevant aria-required aria-selected aria-setsize aria-sort
    aria-valuemax aria-valuemin aria-valuenow aria-valuetext
    className contenteditable contextmenu controls datatype dir draggable dropzone hidden hreflang
    inlist itemid itemref itemscope itemtype lang media ns1:type ns2:alphabet ns2:ph
    onabort onblur oncanplay oncanplaythrough onchange onclick oncontextmenu ondblclick ondrag
    ondragend ondragenter ondragleave ondragover ondragstart ondrop ondurationchange onemptied
    onended onerror onfocus oninput oninvalid onkeydown onkeypress onkeyup onload onloadeddata
    onloadedmetadata onloadstart onmousedown onmousemove onmouseout onmouseover onmouseup
    onmousewheel onpause onplay onplaying onprogress onratechange onreadystatechange onreset
    onscroll onseeked onseeking onselect onshow onstalled onsubmit onsuspend ontimeupdate
    onvolumechange onwaiting
    prefix property rel resource rev role spellcheck style tabindex target type typeof vocab
    xml:base xml:lang xml:space colspan rowspan epub:type epub:prefix
    """.split()
)

# Tags kept in the legacy (version 2) output.
ALLOWED_LEGACY_TAGS = tuple(
    """
    div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd address hr pre blockquote center ins del a span bdo
    br em strong dfn code samp kbd bar cite abbr acronym q sub sup tt i b big small u s strike
    basefont font object param img table caption colgroup col thead tfoot tbody tr th td embed
    applet iframe map noscript ns:svg script var
    """.split()
)

# Picture source types, most wanted first.
PICTURE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/jxl", "image/avif")

# Hosts (short form) that get special treatment.
VIDEO_HOSTS = ("youtube", "youtu.be")
QUOTE_HOSTS = ("twitter", "x")

# Download formats to try in order, for frames and for quotes.
FRAME_FORMATS = (
    "worstvideo[vcodec!*=av01][height>=?420]+bestaudio[acodec!*=opus][abr<120]",
    "worstvideo[vcodec!*=av01][height>=?360]+bestaudio[acodec!*=opus][abr<120]",
    "worstvideo+worstaudio",
)
QUOTE_FORMATS = (
    "worstvideo[vcodec!*=av01][height>=?420]+bestaudio[abr<120]",
    "worstvideo+worstaudio",
    "bestaudio[abr<120]",
)

# Sentences shown where a media element cannot play, and the tool's error text.
NO_MEDIA_TEXT = "There is {kind} content at this location that is not currently supported on your device."
FORMAT_MISSING_TEXT = "Requested format is not available."

# Extension, media type, canonical extension.
MIME = (
    ("png", "image/png", "png"),
    ("jpg", "image/jpeg", "jpeg"),
    ("jpeg", "image/jpeg", "jpeg"),
    ("gif", "image/gif", "gif"),
    ("webp", "image/webp", "webp"),
    ("avif", "image/avif", "avif"),
    ("svg", "image/svg+xml", "svg"),
    ("mp4", "video/mp4", "mp4"),
    ("webm", "video/webm", "webm"),
    ("m4a", "audio/mp4", "m4a"),
    ("mp3", "audio/mpeg", "mp3"),
    ("ogg", "audio/ogg", "ogg"),
    ("apng", "image/apng", "apng"),
    ("bmp", "image/bmp", "bmp"),
    ("ico", "image/vnd.microsoft.icon", "ico"),
    ("tif", "image/tiff", "tif"),
    ("tiff", "image/tiff", "tif"),
    ("jfif", "image/jpeg", "jpeg"),
    ("3gp", "video/3gpp", "3gp"),
    ("avi", "video/x-msvideo", "avi"),
    ("m4v", "video/x-m4v", "m4v"),
    ("mkv", "video/x-matroska", "mkv"),
    ("mov", "video/quicktime", "qt"),
    ("mpeg", "video/mpeg", "mpeg"),
    ("mpg", "video/mpeg", "mpeg"),
    ("ogv", "video/ogg", "ogv"),
    ("aac", "audio/x-aac", "aac"),
    ("flac", "audio/x-flac", "flac"),
    ("mid", "audio/midi", "mid"),
    ("oga", "audio/ogg", "ogg"),
    ("opus", "audio/ogg", "ogg"),
    ("wav", "audio/wav", "wav"),
    ("weba", "audio/webm", "weba"),
    ("jxl", "image/jxl", "jxl"),
    ("heic", "image/heic", "heic"),
    ("heics", "image/heic-sequence", "heics"),
    ("heif", "image/heif", "heif"),
    ("heifs", "image/heif-sequence", "heifs"),
    ("avci", "image/avci", "avci"),
    ("avcs", "image/avcs", "avcs"),
    ("jp2", "image/jp2", "jp2"),
    ("jpg2", "image/jp2", "jp2"),
    ("jpm", "image/jpm", "jpm"),
    ("jpx", "image/jpx", "jpx"),
    ("jpf", "image/jpx", "jpx"),
    ("jph", "image/jph", "jph"),
    ("jxr", "image/jxr", "jxr"),
    ("jpe", "image/jpeg", "jpeg"),
    ("svgz", "image/svg+xml", "svg"),
    ("dib", "image/bmp", "bmp"),
    ("cur", "image/vnd.microsoft.icon", "ico"),
    ("psd", "image/vnd.adobe.photoshop", "psd"),
    ("djvu", "image/vnd.djvu", "djvu"),
    ("djv", "image/vnd.djvu", "djvu"),
    ("wbmp", "image/vnd.wap.wbmp", "wbmp"),
    ("dds", "image/vnd.ms-dds", "dds"),
    ("wdp", "image/vnd.ms-photo", "wdp"),
    ("ktx", "image/ktx", "ktx"),
    ("ktx2", "image/ktx2", "ktx2"),
    ("emf", "image/emf", "emf"),
    ("wmf", "image/wmf", "wmf"),
    ("fits", "image/fits", "fits"),
    ("cgm", "image/cgm", "cgm"),
    ("g3", "image/g3fax", "g3"),
    ("ief", "image/ief", "ief"),
    ("tga", "image/x-tga", "tga"),
    ("pcx", "image/x-pcx", "pcx"),
    ("pnm", "image/x-portable-anymap", "pnm"),
    ("pbm", "image/x-portable-bitmap", "pbm"),
    ("pgm", "image/x-portable-graymap", "pgm"),
    ("ppm", "image/x-portable-pixmap", "ppm"),
    ("xbm", "image/x-xbitmap", "xbm"),
    ("xpm", "image/x-xpixmap", "xpm"),
    ("rgb", "image/x-rgb", "rgb"),
    ("ras", "image/x-cmu-raster", "ras"),
    ("wmv", "video/x-ms-wmv", "wmv"),
    ("wm", "video/x-ms-wm", "wm"),
    ("wmx", "video/x-ms-wmx", "wmx"),
    ("asf", "video/x-ms-asf", "asf"),
    ("asx", "video/x-ms-asf", "asf"),
    ("flv", "video/x-flv", "flv"),
    ("f4v", "video/x-f4v", "f4v"),
    ("fli", "video/x-fli", "fli"),
    ("mng", "video/x-mng", "mng"),
    ("mk3d", "video/x-matroska", "mkv"),
    ("mks", "video/x-matroska", "mkv"),
    ("vob", "video/x-ms-vob", "vob"),
    ("3g2", "video/3gpp2", "3g2"),
    ("3gpp", "video/3gpp", "3gp"),
    ("h261", "video/h261", "h261"),
    ("h263", "video/h263", "h263"),
    ("h264", "video/h264", "h264"),
    ("jpgv", "video/jpeg", "jpgv"),
    ("mj2", "video/mj2", "mj2"),
    ("mjp2", "video/mj2", "mj2"),
    ("ts", "video/mp2t", "ts"),
    ("m2t", "video/mp2t", "ts"),
    ("m2ts", "video/mp2t", "ts"),
    ("mts", "video/mp2t", "ts"),
    ("mp4v", "video/mp4", "mp4"),
    ("mpg4", "video/mp4", "mp4"),
    ("mpe", "video/mpeg", "mpeg"),
    ("m1v", "video/mpeg", "mpeg"),
    ("m2v", "video/mpeg", "mpeg"),
    ("qt", "video/quicktime", "qt"),
    ("movie", "video/x-sgi-movie", "movie"),
    ("viv", "video/vnd.vivo", "viv"),
    ("aif", "audio/x-aiff", "aif"),
    ("aiff", "audio/x-aiff", "aif"),
    ("aifc", "audio/x-aiff", "aif"),
    ("adp", "audio/adpcm", "adp"),
    ("amr", "audio/amr", "amr"),
    ("au", "audio/basic", "au"),
    ("snd", "audio/basic", "au"),
    ("caf", "audio/x-caf", "caf"),
    ("dts", "audio/vnd.dts", "dts"),
    ("kar", "audio/midi", "mid"),
    ("midi", "audio/midi", "mid"),
    ("rmi", "audio/midi", "mid"),
    ("m2a", "audio/mpeg", "mp3"),
    ("m3a", "audio/mpeg", "mp3"),
    ("mp2", "audio/mpeg", "mp3"),
    ("mp2a", "audio/mpeg", "mp3"),
    ("mpga", "audio/mpeg", "mp3"),
    ("mp4a", "audio/mp4", "m4a"),
    ("m3u", "audio/x-mpegurl", "m3u"),
    ("mka", "audio/x-matroska", "mka"),
    ("pya", "audio/vnd.ms-playready.media.pya", "pya"),
    ("ra", "audio/x-realaudio", "ra"),
    ("ram", "audio/x-pn-realaudio", "ram"),
    ("s3m", "audio/s3m", "s3m"),
    ("spx", "audio/ogg", "ogg"),
    ("wax", "audio/x-ms-wax", "wax"),
    ("wma", "audio/x-ms-wma", "wma"),
    ("xm", "audio/xm", "xm"),
)

# Schemes of the web and the port each has of its own.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

# First letters of the months, and the named zones of mail dates with their hours from UTC.
MONTHS = tuple("jan feb mar apr may jun jul aug sep oct nov dec".split())
ZONES = {"utc": 0, "gmt": 0, "ut": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

# HTML standard element classes.
VOID_TAGS = tuple("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = tuple(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead title tr ul
    """.split()
)
# Phrasing tags whose end tag only counts before the next block tag.
PHRASE_TAGS = tuple(
    """
    abbr b bdi bdo big cite code dfn em font i kbd label mark nobr q s samp small span strike strong
    sub sup time tt u var
    """.split()
)
# Tags whose end tag may be left out: an unclosed one reaches to the next block tag.
OPTIONAL_END_TAGS = tuple("li dt dd td th".split())
# Tags that, left open outside every closed element, reach to the end of the page.
PAGE_LONG_TAGS = tuple(
    """
    html body main article section div header footer aside nav ul ol table figure blockquote form
    title textarea xmp plaintext
    """.split()
)

# Tags removed with their content by the sanitizer: active elements, those whose content is read by other rules than markup,
# and what is no part of an article.
UNSAFE_TAGS = tuple(
    """
    script object embed applet iframe base link meta frame frameset noembed template noframes noscript
    style title head xmp plaintext svg
    """.split()
)
# Tags the sanitizer keeps: HTML elements for content, and MathML for presentation. Of others only the content stays.
SAFE_TAGS = tuple(
    """
    address article aside footer h1 h2 h3 h4 h5 h6 header hgroup main nav section
    blockquote dd div dl dt figcaption figure hr li menu ol p pre ul center dir
    a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby
    s samp small span strike strong sub sup time tt u var wbr
    area audio img map picture source track video
    caption col colgroup table tbody td tfoot th thead tr
    button datalist fieldset form input label legend meter optgroup option output progress select textarea
    details dialog summary
    math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace
    msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover
    """.split()
)
LINK_ATTRIBUTES = tuple("action background cite data formaction href longdesc poster src xlink:href".split())

# Named character references that are decoded: those of HTML 4, and the apostrophe.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
