"""Fixed values of the rules in `prose` and `claims`: patterns and word lists that results depend on, each
list in its own order and whole. The rules themselves are where these are used."""

#: LaTeX whose numbers are no quantities of the prose.
LATEX_MASKS = (
    r"\\(?:SI|SIrange|qty|qtyrange|num|si|SIlist|qtylist)\{[^{}]*\}(?:\{[^{}]*\})?",
    r"\\code\{[^{}]*\}",
    r"\\verb\*?([^A-Za-z\s])(?:(?!\1).)*\1",
    r"\\url\{[^{}]*\}",
    r"\\href\{[^{}]*\}\{[^{}]*\}",
    r"\\cite[a-zA-Z]*\{[^{}]*\}",
    r"\\(?:ref|eqref|cref|Cref|label|bibitem|nocite)\{[^{}]*\}",
    r"\$[^$]*\$",
    r"\\\([^)]*\\\)",
    r"\\begin\{tabular\}.*?\\end\{tabular\}",
    r"\\begin\{pgfplotstable\}.*?\\end\{pgfplotstable\}",
)
#: Units that a number outside the macros may have.
UNITS = r"\\%|%|percent|fold|×|kbp|kb|Mbp|Mb|Gbp|Gb|bp|µm|um|nm|mm|cm|mL|µL|uL|ng|µg|ug|mg|h\b|min\b|s\b|ms\b|°C|mM|µM|uM|nM|pM|mol|GB|MB|GHz"

#: A figure's legend, and what it claims or how it joins its parts.
FIGURE = r"(?i)^\s*(?:Fig\.?|Figure)\s*[A-Z]?\d+"
LEGEND_ARGUES = r"(?i)\bconsistent\s+with\b[^.]{0,100}\b(?:leading|best|outperform)"
LEGEND_EXCUSED = r"(?i)\b(?:p\s*[<=>]|statistic|descriptive|descriptively)\b"
LEGEND_ORDER = r"(?i)from\s+top\s+to\s+bottom"
LEGEND_CONNECTIVES = r"(?i)\b(?:below\s+them|this\s+is\s+followed\s+by|next,?)\b"

#: What says that something was shipped or deposited, and what says where.
SHIPPED = r"(?i)\bshipped\b|\b(?:was|were|is|are|has been|have been)\s+deposited\b"
SHIPPED_WHERE = r"(?i)https?://|\b10\.[0-9]{4,9}/|\bshipped\s+with\b|from the corresponding author|\b[\w./-]+\.(?:tsv|csv|zip|pdf|docx|tex|bib|py|r|txt|json|xlsx?)\b"

#: Promises instead of a place, the first that is found names the line.
PROMISES = (
    ("not yet deposited", r"(?i)\bnot\s+yet\s+deposited\b"),
    ("to be deposited", r"(?i)\b(?:to|will)\s+be\s+deposited\b"),
    ("deposited ... before publication", r"(?i)\bdeposit(?:ed|ing)?\b[^.]{0,80}\bbefore\s+publication\b"),
    (
        "promised ... before publication",
        r"(?i)(?:\b(?:will|shall|to)\s+be\s+(?:added|uploaded|released|shared|posted|archived|deposited|made\s+available|available)\b"
        r"[^.]{0,80}\b(?:before|prior\s+to|(?:up)?on|after)\s+(?:publication|acceptance)\b"
        r"|\b(?:before|prior\s+to|(?:up)?on|after)\s+(?:publication|acceptance)\b"
        r"[^.]{0,80}\b(?:will|shall|to)\s+be\s+(?:added|uploaded|released|shared|posted|archived|deposited|made\s+available|available)\b)",
    ),
    ("available from the lead contact", r"(?i)\bavailable\s+from\s+the\s+(?:lead\s+)?contact\b"),
    ("available on request", r"(?i)\bavailable\s+(?:up)?on\s+(?:reasonable\s+)?request\b"),
    ("available from the authors", r"(?i)\bavailable\s+from\s+the\s+authors\b"),
    (
        "in the meantime",
        r"(?i)\b(?:availab\w*|deposit\w*|request|share\w*|archiv\w*|obtain\w*)\b[^.]{0,80}\bin\s+the\s+meantime\b|"
        r"\bin\s+the\s+meantime\b[^.]{0,80}\b(?:availab\w*|deposit\w*|request|share\w*|archiv\w*|obtain\w*)\b",
    ),
    ("archived on acceptance", r"(?i)\barchived\b[^.]{0,60}\b(?:on|upon|after)\s+acceptance\b"),
    ("available ... on request", r"(?i)\bavailab\w*[^.]{0,60}\b(?:up)?on\s+(?:reasonable\s+)?request\b"),
    ("available ... upon publication", r"(?i)\bavailab\w*[^.]{0,40}\b(?:up)?on\s+publication\b"),
    ("shared ... on request", r"(?i)\bshar(?:ed|ing)\b[^.]{0,60}\b(?:up)?on\s+(?:reasonable\s+)?request\b"),
)
#: A repository's address with a commit: host, path, commit.
PIN = r"(?i)https?://(?:www\.)?(github\.com|gitlab\.com|bitbucket\.org|codeberg\.org)/([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+)(?:/-)?/(?:tree|commit|blob)/([0-9a-fA-F]{7,40})"

#: Symbols of genes and proteins, words that are none, words about genes, labels before a number.
GENE_SYMBOL = (
    r"\b(?![A-Z]{1,2}\d*\b(?:\s*(?:kb|Mb|GB|GHz)\b))(?!(?:v|hg|grch|GRCh)\d)"
    r"([A-Z][A-Z0-9]{1,5}\d[A-Z0-9]?\d?|[A-Z]{3,5}\d|[A-Z]{3,5})\b"
)
NO_GENES = (
    "COVID19 SARS2 PCR2 R2 N50 L2 T2 M1 M2 S1 S2 F1 F2 P1 P2 CD8 CD4 DNA RNA ATP SDS PBS PCR FACS DAPI SNP INDEL WGA BAM BED TSV CSV DOI URL "
    "GPU CPU RAM SI IQR ROC AUC PCC CN CNV CNA ITH WGD HMM GMM BIC SD SEM ANOVA GIAB NIST ACT MALBAC META CHM GRCH HG T2T MDA DLP GEO SRA "
    "NCBI MIT TCGA GTF FASTQ FALSE TRUE NONE NULL COLO UMI MCMC BAF ATAC SBS CPM TPM FPKM HVG PCA UMAP TSNE KF NMD SCOPE STAR EAGLE SEURAT "
    "COSMIC GINKGO CHISEL FLCNA SCYN SCEVAN CONICSMAT CASPER INFERCNV COPYCAT NUMBAT"
).split()
GENE_LANGUAGE = (
    r"(?i)\b(?:gene|genes|protein|mutation|mutations|expression|amplification|amplified|deletion|locus|oncogene|tumou?r suppressor|wild-type|"
    r"knockdown|knockout|CRISPR|transcript|allele|isoform|rearrangement)\b"
)
GENE_MASKS = r"\\code\{[^{}]*\}|\\url\{[^{}]*\}|\$[^$]*\$"
GENE_LABELS = r"(?:Fig|Table|Eq|Ref|Supplementary|Section)\.?\s*$"

#: Hand-off placeholders, what can be looked up, and the kinds in the order they are tried.
PLACEHOLDER = r"(?i)\[\s*AUTHOR\s+TO\s+COMPLETE\b([^\]]*)\]"
FINDABLE = r"preprint|doi|accession|database|repository|zenodo|figshare|geo\b|sra\b|arrayexpress|version|registration|url"
PLACEHOLDER_KINDS = (
    ("preprint", ("preprint",)),
    ("archive", (r"persistent identifier|\bdoi\b", "archiv|zenodo|figshare|persistent")),
    ("doi", (r"persistent identifier|\bdoi\b",)),
    ("accession", (r"accession|\b(?:geo|sra|bioproject)\b",)),
    ("orcid", ("orcid",)),
    ("repository", ("repositor|github|url|commit",)),
)
