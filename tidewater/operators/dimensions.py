"""Dimension tables that the analysis is defined by, as plain text, and their DataFrames. All are far below a broadcast's bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (family, effect, symbols); a symbol that occurs again overrides what came before.
FAMILY_SYMBOLS = [
    ("C_HEAP", "Acquire", ["malloc", "calloc", "realloc", "valloc", "pvalloc", "memalign", "posix_memalign", "aligned_alloc", "reallocarray"]),
    ("C_HEAP", "Release", ["free"]),
    ("C_HEAP", "Retain", ["malloc_set_zone_name"]),
    ("CPP_NEW_SCALAR", "Acquire", ["_Znwm", "_Znwj", "operator new", "cpp_new_object"]),
    ("CPP_NEW_SCALAR", "Release", ["_ZdlPv", "operator delete", "cpp_delete_object"]),
    ("CPP_NEW_ARRAY", "Acquire", ["_Znam", "_Znaj", "operator new[]"]),
    ("CPP_NEW_ARRAY", "Release", ["_ZdaPv", "operator delete[]"]),
    ("RUST_GLOBAL", "Acquire", ["__rust_alloc", "__rust_alloc_zeroed", "__rust_realloc", "rust_box_new"]),
    ("RUST_GLOBAL", "Release", ["__rust_dealloc", "__rdl_dealloc", "__rg_dealloc"]),
    ("RUST_RAW_OWNERSHIP", "Escape", ["Box::into_raw", "CString::into_raw"]),
    ("RUST_RAW_OWNERSHIP", "Reclaim", ["Box::from_raw", "CString::from_raw", "Vec::from_raw_parts"]),
    ("PYTHON_OBJECT", "Acquire", ["PyObject_New", "PyObject_NewVar", "PyType_GenericAlloc", "PyBytes_FromStringAndSize", "PyBytes_FromString", "PyUnicode_FromString", "PyUnicode_FromStringAndSize", "PyList_New", "PyTuple_New", "PyDict_New", "PySet_New", "PyList_GetItemRef"]),
    ("PYTHON_OBJECT", "Release", ["PyObject_Del", "PyObject_Free", "PyTuple_SetItem", "PyList_SetItem"]),
    ("PYTHON_OBJECT", "ConditionalRelease", ["Py_DECREF", "Py_XDECREF"]),
    ("PYTHON_OBJECT", "Retain", ["Py_INCREF", "PyList_GetItem", "PyBytes_AsString", "PyUnicode_AsUTF8"]),
    ("PYTHON_MEM", "Acquire", ["PyMem_Malloc", "PyMem_Calloc", "PyMem_Realloc", "ctypes_alloc"]),
    ("PYTHON_MEM", "Release", ["PyMem_Free"]),
    ("PYTHON_MEM_RAW", "Acquire", ["PyMem_RawMalloc", "PyMem_RawCalloc", "PyMem_RawRealloc"]),
    ("PYTHON_MEM_RAW", "Release", ["PyMem_RawFree"]),
    ("JAVA_LOCAL_REF", "Acquire", ["NewLocalRef", "GetStringUTFChars", "GetStringCritical", "GetPrimitiveArrayCritical", "GetByteArrayElements", "jni_alloc"]),
    ("JAVA_LOCAL_REF", "Release", ["DeleteLocalRef", "ReleaseStringUTFChars", "ReleaseStringCritical", "ReleasePrimitiveArrayCritical", "ReleaseByteArrayElements"]),
    ("JAVA_GLOBAL_REF", "Acquire", ["NewGlobalRef", "NewStringUTF", "NewByteArray"]),
    ("JAVA_GLOBAL_REF", "Release", ["DeleteGlobalRef"]),
    ("CSHARP_HGLOBAL", "Acquire", ["AllocHGlobal", "Marshal_AllocHGlobal", "Marshal.AllocHGlobal"]),
    ("CSHARP_HGLOBAL", "Release", ["FreeHGlobal", "Marshal_FreeHGlobal", "Marshal.FreeHGlobal"]),
    ("CSHARP_COTASK", "Acquire", ["CoTaskMemAlloc"]),
    ("CSHARP_COTASK", "Release", ["CoTaskMemFree"]),
    ("GO_GC", "Acquire", ["runtime.mallocgc", "runtime.alloc", "go_alloc"]),
    ("GO_CGO", "Acquire", ["_cgo_allocate", "_Cfunc_GoMalloc"]),
    ("GO_CGO", "Release", ["_cgo_free", "_Cfunc_GoFree"]),
    ("GO_GC", "Release", ["go_free"]),
    ("ZLIB_STREAM", "Acquire", ["inflateInit_", "inflateInit2_", "deflateInit_", "deflateInit2_"]),
    ("ZLIB_STREAM", "Release", ["inflateEnd", "deflateEnd"]),
    ("OPENSSL_RESOURCE", "Acquire", ["EVP_CIPHER_CTX_new", "BIO_new", "RSA_new", "BN_new"]),
    ("OPENSSL_RESOURCE", "Release", ["EVP_CIPHER_CTX_free", "BIO_free", "BIO_free_all", "RSA_free", "BN_free", "BN_clear_free"]),
    ("SQLITE_RESOURCE", "Acquire", ["sqlite3_open", "sqlite3_open_v2", "sqlite3_prepare_v2", "sqlite3_prepare_v3"]),
    ("SQLITE_RESOURCE", "Release", ["sqlite3_close", "sqlite3_close_v2", "sqlite3_finalize", "sqlite3_free"]),
    ("MIMALLOC", "Acquire", ["mi_malloc", "mi_realloc", "mi_calloc", "mi_malloc_aligned"]),
    ("MIMALLOC", "Release", ["mi_free"]),
    ("MIMALLOC", "ConditionalRelease", ["mi_heap_destroy"]),
    ("SWIFT_ALLOC", "Acquire", ["swift_alloc", "swift_allocObject"]),
    ("SWIFT_ALLOC", "Release", ["swift_dealloc"]),
    ("FILE_DESCRIPTOR", "Acquire", ["open", "openat", "creat", "socket", "accept", "accept4", "dup", "dup2", "dup3", "pipe", "pipe2"]),
    ("FILE_DESCRIPTOR", "Release", ["close"]),
    ("WIN32_HEAP", "Acquire", ["HeapAlloc", "HeapReAlloc", "LocalAlloc", "LocalReAlloc", "GlobalAlloc", "GlobalReAlloc"]),
    ("WIN32_HEAP", "Release", ["HeapFree", "LocalFree", "GlobalFree"]),
    ("WIN32_HEAP", "Retain", ["GetProcessHeap"]),
    ("WIN32_VIRTUAL", "Acquire", ["VirtualAlloc", "VirtualAllocEx"]),
    ("WIN32_VIRTUAL", "Release", ["VirtualFree", "VirtualFreeEx"]),
]
# Family, kind, lifetime, families whose releases are compatible with it.
FAMILIES = [
    ("C_HEAP", "ManualHeap", "ExplicitFree", []),
    ("CPP_NEW_SCALAR", "ManualHeap", "ExplicitFree", []),
    ("CPP_NEW_ARRAY", "ManualHeap", "ExplicitFree", []),
    ("RUST_GLOBAL", "ManualHeap", "ExplicitFree", []),
    ("PYTHON_OBJECT", "RefCounted", "ExplicitFree", ["PYTHON_OBJECT"]),
    ("PYTHON_MEM", "ManualHeap", "ExplicitFree", []),
    ("PYTHON_MEM_RAW", "ManualHeap", "ExplicitFree", ["C_HEAP"]),
    ("JAVA_LOCAL_REF", "HandleBased", "CallLocal", []),
    ("JAVA_GLOBAL_REF", "HandleBased", "ExplicitFree", []),
    ("CSHARP_HGLOBAL", "ManualHeap", "ExplicitFree", []),
    ("CSHARP_COTASK", "ManualHeap", "ExplicitFree", []),
    ("GO_GC", "GcManaged", "GcManaged", []),
    ("ZLIB_STREAM", "LibraryManaged", "ExplicitFree", []),
    ("OPENSSL_RESOURCE", "LibraryManaged", "ExplicitFree", []),
    ("SQLITE_RESOURCE", "LibraryManaged", "ExplicitFree", []),
    ("GO_CGO", "GcManaged", "GcManaged", ["GO_GC"]),
    ("MIMALLOC", "ManualHeap", "ExplicitFree", ["C_HEAP"]),
    ("CSHARP_COM", "HandleBased", "ExplicitFree", ["C_HEAP"]),
    ("RUST_RAW_OWNERSHIP", "ManualHeap", "ExplicitFree", ["RUST_GLOBAL"]),
    ("FILE_DESCRIPTOR", "FileDescriptor", "ExplicitFree", []),
    ("UNKNOWN", "ManualHeap", "Unknown", []),
    ("WIN32_HEAP", "HandleBased", "ExplicitFree", []),
    ("WIN32_VIRTUAL", "HandleBased", "ExplicitFree", []),
]
# Library contracts (source, type, function, paired releases, ownership; ! marks the error-prone).
CONTRACTS = """
glib Allocator g_malloc g_free CallerOwns
glib Allocator g_malloc0 g_free CallerOwns
glib Allocator g_realloc g_free CallerOwns
glib Allocator g_strdup g_free CallerOwns
glib Allocator g_new g_free CallerOwns
glib Allocator g_strndup g_free CallerOwns
glib Deallocator g_free - CallerOwns
glib Retainer g_object_ref g_object_unref ReferenceCounted
glib Releaser g_object_unref - ReferenceCounted
glib Borrower g_object_get_data - Borrowed!
jni Allocator NewLocalRef DeleteLocalRef CallerOwns
jni Allocator NewGlobalRef DeleteGlobalRef CallerOwns
jni Allocator GetStringUTFChars ReleaseStringUTFChars CallerOwns!
jni Allocator GetByteArrayElements ReleaseByteArrayElements CallerOwns!
jni Allocator GetPrimitiveArrayCritical ReleasePrimitiveArrayCritical CallerOwns!
jni Allocator NewStringUTF DeleteLocalRef CallerOwns
jni Allocator NewByteArray DeleteLocalRef CallerOwns
jni Allocator FindClass DeleteLocalRef CallerOwns
jni Allocator NewObject DeleteLocalRef CallerOwns
jni Deallocator DeleteLocalRef - CallerOwns
jni Deallocator DeleteGlobalRef - CallerOwns
jni Deallocator ReleaseStringUTFChars - CallerOwns
jni Deallocator ReleaseByteArrayElements - CallerOwns
jni Deallocator ReleasePrimitiveArrayCritical - CallerOwns
jni Borrower GetObjectArrayElement - Borrowed
libuv Allocator uv_loop_init uv_loop_close CallerOwns
libuv Allocator uv_handle_init uv_close CallerOwns
libuv Allocator uv_req_init - CallerOwns
libuv Allocator uv_timer_init uv_close CallerOwns
libuv Allocator uv_tcp_init uv_close CallerOwns
libuv Deallocator uv_loop_close - CallerOwns
libuv Deallocator uv_close - CallerOwns
libuv Borrower uv_default_loop - Borrowed
openssl Allocator SSL_CTX_new SSL_CTX_free CallerOwns
openssl Allocator SSL_new SSL_free CallerOwns
openssl Allocator BIO_new BIO_free/BIO_free_all CallerOwns
openssl Allocator BIO_new_connect BIO_free/BIO_free_all CallerOwns
openssl Allocator BIO_new_ssl BIO_free/BIO_free_all CallerOwns
openssl Allocator EVP_CIPHER_CTX_new EVP_CIPHER_CTX_free CallerOwns
openssl Allocator EVP_MD_CTX_new EVP_MD_CTX_free CallerOwns
openssl Allocator RSA_new RSA_free CallerOwns
openssl Allocator BN_new BN_free/BN_clear_free CallerOwns
openssl Allocator OPENSSL_malloc OPENSSL_free CallerOwns
openssl Allocator OPENSSL_strdup OPENSSL_free CallerOwns
openssl Allocator CRYPTO_secure_malloc CRYPTO_secure_free CallerOwns
openssl Deallocator SSL_CTX_free - CallerOwns
openssl Deallocator SSL_free - CallerOwns
openssl Deallocator BIO_free - CallerOwns
openssl Deallocator BIO_free_all - CallerOwns
openssl Deallocator EVP_CIPHER_CTX_free - CallerOwns
openssl Deallocator EVP_MD_CTX_free - CallerOwns
openssl Deallocator RSA_free - CallerOwns
openssl Deallocator BN_free - CallerOwns
openssl Deallocator BN_clear_free - CallerOwns
openssl Deallocator OPENSSL_free - CallerOwns
openssl Deallocator OPENSSL_clear_free - CallerOwns
openssl Deallocator CRYPTO_secure_free - CallerOwns
openssl Deallocator X509_free - CallerOwns
openssl Borrower SSL_get_peer_certificate - Borrowed!
posix Allocator malloc free CallerOwns
posix Allocator calloc free CallerOwns
posix Allocator realloc free CallerOwns
posix Allocator strdup free CallerOwns
posix Allocator strndup free CallerOwns
posix Allocator aligned_alloc free CallerOwns
posix Allocator open close CallerOwns
posix Allocator openat close CallerOwns
posix Allocator creat close CallerOwns
posix Allocator dup close CallerOwns
posix Allocator dup2 close CallerOwns
posix Allocator fdopen fclose CallerOwns
posix Allocator fopen fclose CallerOwns
posix Allocator socket close CallerOwns
posix Allocator accept close CallerOwns
posix Allocator accept4 close CallerOwns
posix Allocator mmap munmap CallerOwns
posix Allocator fork - CallerOwns
posix Allocator pipe close CallerOwns
posix Allocator pipe2 close CallerOwns
posix Allocator opendir closedir CallerOwns
posix Allocator pthread_key_create pthread_key_delete CallerOwns
posix Deallocator free - CallerOwns
posix Deallocator close - CallerOwns
posix Deallocator fclose - CallerOwns
posix Deallocator munmap - CallerOwns
posix Deallocator closedir - CallerOwns
posix Deallocator pthread_key_delete - CallerOwns
python Allocator PyObject_New Py_DECREF/Py_XDECREF ReferenceCounted
python Allocator PyObject_NewVar Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyType_GenericAlloc Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyBytes_FromStringAndSize Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyBytes_FromString Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyUnicode_FromString Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyUnicode_FromStringAndSize Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyList_New Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyTuple_New Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyDict_New Py_DECREF/Py_XDECREF CallerOwns
python Allocator PySet_New Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyList_GetItemRef Py_DECREF/Py_XDECREF CallerOwns
python Allocator PyDict_GetItemRef Py_DECREF/Py_XDECREF CallerOwns
python Allocator Py_BuildValue Py_DECREF ReferenceCounted
python Allocator PyGILState_Ensure PyGILState_Release CallerOwns
python Releaser Py_DECREF - ReferenceCounted
python Releaser Py_XDECREF - ReferenceCounted
python Retainer Py_INCREF Py_DECREF ReferenceCounted
python Retainer Py_XINCREF - ReferenceCounted
python Borrower PyList_GetItem - Borrowed!
python Borrower PyTuple_GetItem - Borrowed!
python Borrower PyDict_GetItem - Borrowed!
python Transfer PyTuple_SetItem - Transferred!
python Transfer PyList_SetItem - Transferred!
python Deallocator PyObject_Del - CallerOwns
python Deallocator PyObject_Free - CallerOwns
python Deallocator PyGILState_Release - CallerOwns
sqlite Allocator sqlite3_open sqlite3_close/sqlite3_close_v2 CallerOwns
sqlite Allocator sqlite3_open_v2 sqlite3_close/sqlite3_close_v2 CallerOwns
sqlite Allocator sqlite3_prepare_v2 sqlite3_finalize CallerOwns
sqlite Allocator sqlite3_prepare_v3 sqlite3_finalize CallerOwns
sqlite Allocator sqlite3_malloc sqlite3_free CallerOwns
sqlite Deallocator sqlite3_close - CallerOwns
sqlite Deallocator sqlite3_close_v2 - CallerOwns
sqlite Deallocator sqlite3_finalize - CallerOwns
sqlite Deallocator sqlite3_free - CallerOwns
sqlite Borrower sqlite3_column_text - Borrowed!
sqlite Borrower sqlite3_column_blob - Borrowed!
sqlite Borrower sqlite3_exec - Borrowed
zlib Allocator inflateInit_ inflateEnd CallerOwns
zlib Allocator inflateInit2_ inflateEnd CallerOwns
zlib Allocator deflateInit_ deflateEnd CallerOwns
zlib Allocator deflateInit2_ deflateEnd CallerOwns
zlib Deallocator inflateEnd - CallerOwns
zlib Deallocator deflateEnd - CallerOwns
"""
# Gate rules in order (issue kinds; semantic kinds; probe; verdict). The first that fits an issue decides.
GATE_RULES = """
BorrowEscape; HeapProvenance; symbol; SuppressHeapOrigin
BorrowEscape; GlobalProvenance; symbol; SuppressGlobalOrigin
BorrowEscape; FromParameter; symbol; SuppressFromParameter
BorrowEscape; LibraryRelease; symbol; SuppressLibraryRelease
UseAfterFree; RaiiDropRelease; symbol; SuppressRaii
UseAfterFree; LibraryRelease; symbol; SuppressLibraryRelease
WriteToImmutable; MutableParam; symbol; SuppressMutableParam
WriteToImmutable; InteriorMutability; symbol; SuppressInteriorMut
CrossLanguageFree; IntoRawTransfer; symbol; SuppressOwnershipTransfer
CrossLanguageFree; FileOperation; symbol; SuppressNonMemorySyscall
CrossLanguageFree; NetworkOperation; symbol; SuppressNonMemorySyscall
CrossLanguageFree; ProcessOperation; symbol; SuppressNonMemorySyscall
CrossLanguageFree; LibraryRelease; symbol; SuppressLibraryRelease
CrossLanguageFree; RuntimeInternal; symbol; SuppressRuntimeInternal
OwnershipViolation; IntoRawTransfer; symbol; SuppressOwnershipTransfer
OwnershipViolation; FileOperation, NetworkOperation, ProcessOperation; symbol; SuppressNonMemorySyscall
OwnershipViolation; LibraryRelease; symbol; SuppressLibraryRelease
OwnershipViolation; RuntimeInternal; symbol; SuppressRuntimeInternal
OwnershipViolation; PythonRefcountInc, PythonRefcountDec, PythonBorrowedRef, PythonOwnedRef, PythonGilProtected, PythonRefcountManaged; symbol or caller; SuppressRaii
DoubleFree; RaiiDropRelease; symbol; SuppressRaii
DoubleFree; LibraryRelease; symbol; SuppressLibraryRelease
InvalidFree; LibraryRelease; symbol; SuppressLibraryRelease
UncheckedReturn; HeapProvenance; symbol; SuppressAllocatorReturn
UncheckedReturn; GoRuntimeAlloc; symbol; SuppressAllocatorReturn
UncheckedReturn; NullChecked; symbol; SuppressNullChecked
UncheckedReturn; NullChecked; caller; SuppressNullChecked
CrossFamilyFree; IntoRawTransfer; symbol; SuppressOwnershipTransfer
CrossFamilyFree; FileOperation, NetworkOperation, ProcessOperation; symbol; SuppressNonMemorySyscall
FfiUnsafeCall; FileOperation, NetworkOperation, ProcessOperation; symbol; SuppressNonMemorySyscall
FfiUnsafeCall; LibraryRelease; symbol; SuppressLibraryRelease
FfiUnsafeCall; IntoRawTransfer; symbol; SuppressOwnershipTransfer
FfiUnsafeCall; RaiiDropRelease; symbol; SuppressRaii
FfiUnsafeCall; HeapProvenance, GlobalProvenance; symbol; SuppressHeapOrigin
FfiUnsafeCall; FromParameter; symbol; SuppressFromParameter
FfiUnsafeCall; CppDestructor, CppUniquePtr, CppSharedPtr; symbol; SuppressRaii
FfiUnsafeCall; GoDeferCleanup, GoFinalizer; symbol; SuppressRaii
FfiUnsafeCall; PythonRefcountInc, PythonRefcountDec, PythonBorrowedRef, PythonOwnedRef, PythonGilProtected; symbol; SuppressRaii
FfiUnsafeCall; CsharpSafeHandle, CsharpFinalizer; symbol; SuppressRaii
FfiUnsafeCall; JavaLocalRef, JavaGlobalRef, JavaWeakRef; symbol; SuppressRaii
FfiUnsafeCall; RuntimeInternal; symbol; SuppressRuntimeInternal
ConditionalLeak,DefiniteLeak; RaiiDropRelease; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; CppDestructor, CppUniquePtr, CppSharedPtr; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; GoDeferCleanup, GoFinalizer; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; PythonRefcountInc, PythonRefcountDec, PythonBorrowedRef, PythonOwnedRef, PythonGilProtected; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; CsharpSafeHandle, CsharpFinalizer; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; JavaLocalRef, JavaGlobalRef, JavaWeakRef; symbol; SuppressRaii
ConditionalLeak,DefiniteLeak; HeapProvenance, GlobalProvenance; symbol; SuppressHeapOrigin
ConditionalLeak,DefiniteLeak; RuntimeInternal; symbol; SuppressRuntimeInternal
OwnershipEscapeLeak; RaiiDropRelease; symbol; SuppressRaii
OwnershipEscapeLeak; CppDestructor, CppUniquePtr, CppSharedPtr; symbol; SuppressRaii
OwnershipEscapeLeak; GoDeferCleanup, GoFinalizer; symbol; SuppressRaii
OwnershipEscapeLeak; IntoRawTransfer; symbol; SuppressOwnershipTransfer
OwnershipEscapeLeak; RuntimeInternal; symbol; SuppressRuntimeInternal
NullDereference; NullChecked; symbol; SuppressNullChecked
NullDereference; NullChecked; caller; SuppressNullChecked
"""
# Candidate kind, base risk (multiplicative), base risk (additive), issue kind, CWE, fault class.
CANDIDATE_KINDS = [
    ("CrossFamilyFree", 0.9, 0.9, "CrossFamilyFree", 762, "WrongRelease"),
    ("UseAfterRelease", 0.85, 0.95, "UseAfterFree", 416, "UseAfterRelease"),
    ("DoubleRelease", 0.8, 0.95, "DoubleFree", 415, "DoubleRelease"),
    ("ConditionalLeak", 0.6, 0.6, "ConditionalLeak", 772, "Leak"),
    ("DefiniteLeak", 0.85, 0.85, "DefiniteLeak", 772, "Leak"),
    ("BorrowEscape", 0.55, 0.5, "BorrowEscape", 822, "BoundaryMisuse"),
    ("CallbackEscape", 0.3, 0.3, "CallbackEscapeIssue", 749, "UseAfterRelease"),
    ("NeedsModel", 0.1, 0.1, "NeedsModel", None, "Unmodeled"),
    ("DoubleReclaim", 0.85, 0.9, "DoubleReclaim", 415, "DoubleRelease"),
    ("OwnershipEscapeLeak", 0.65, 0.7, "OwnershipEscapeLeak", 772, "Leak"),
    ("UseAfterFree", 0.9, 0.95, "UseAfterFree", 416, "UseAfterRelease"),
    ("InvalidBorrowedFree", 0.85, 0.9, "InvalidFree", 763, "WrongRelease"),
    ("UncheckedFfiReturn", 0.75, 0.7, "UncheckedReturn", 252, "BoundaryMisuse"),
    ("NullDereference", 0.95, 0.8, "NullDereference", 476, "BoundaryMisuse"),
    ("CrossLanguageFree", 0.9, 0.9, "CrossLanguageFree", 762, "WrongRelease"),
    ("AbiLayoutMismatch", 0.3, 0.4, "FfiTypeMismatch", 843, "BoundaryMisuse"),
    ("BoundaryMisuse", 0.8, 0.8, "BorrowEscape", 822, "BoundaryMisuse"),
]
# Verdict, weight (multiplicative), weight (additive), severity, rank.
VERDICTS = [("Confirmed", 1.0, 1.0, "Error", 3), ("Probable", 0.7, 0.7, "Warning", 2), ("Diagnostic", 0.3, 0.2, "Note", 1), ("ExplainedSafe", 0.0, 0.0, "Note", 0)]
# A reportable cause subsumes its effect.
SUBSUMES = [("WrongRelease", "Leak"), ("DoubleRelease", "Leak"), ("BoundaryMisuse", "Leak"), ("UseAfterRelease", "DoubleRelease")]
EVENTS = ("Release", "ConditionalRelease", "Escape", "Transfer", "Retain", "Borrow")
# Next state or error of each event, in the order of EVENTS. DR: double release, RB: release of a borrowed
# resource, IT: invalid transition; on an error the state stays.
TRANSITIONS = {
    "Acquired": ("Released", "Released", "Escaped", "Transferred", "Retained", "Borrowed"),
    "Retained": ("Released", "Acquired", "Escaped", "Transferred", "Retained", "Borrowed"),
    "Released": ("DR", "DR", "IT", "IT", "IT", "IT"),
    "Borrowed": ("RB", "RB", "IT", "IT", "IT", "Borrowed"),
    "Escaped": ("Released", "Released", "Escaped", "IT", "IT", "IT"),
    "Transferred": ("IT", "IT", "IT", "IT", "IT", "IT"),
    "Untracked": ("IT", "IT", "IT", "IT", "IT", "IT"),
    "Unknown": ("IT", "IT", "IT", "IT", "IT", "IT"),
}
ERRORS = {"DR": "DoubleRelease", "RB": "ReleaseBorrowed", "IT": "InvalidTransition"}


def symbol_rows() -> list[tuple[str, str, str]]:
    """(symbol, family, effect), one row a symbol."""
    last = {s: (f, e) for f, e, symbols in FAMILY_SYMBOLS for s in symbols}
    return [(s, f, e) for s, (f, e) in last.items()]


def family_symbols(spark: SparkSession, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """The registry; rows of ``extra`` (symbol, family, effect) override it."""
    rows = {s: (f, e) for s, f, e in [*symbol_rows(), *extra]}
    return spark.createDataFrame([(s, f, e) for s, (f, e) in rows.items()], "symbol string, family string, effect string")


def compat_rows() -> list[tuple[str, str]]:
    """(acquire family, release family) that go together: each with itself, and the listed ones. Directional."""
    return [(f, f) for f, *_ in FAMILIES] + [(f, r) for f, _, _, rs in FAMILIES for r in rs if r != f]


def family_compat(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(compat_rows(), "acquire_family string, release_family string")


def contract_rows() -> list[tuple[str, str, str, list[str], str, bool]]:
    out = []
    for line in CONTRACTS.split("\n"):
        if line:
            source, kind, function, releases, ownership = line.split()
            out.append((source, kind, function, [] if releases == "-" else releases.split("/"), ownership.rstrip("!"), ownership.endswith("!")))
    return out


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(contract_rows(), "source string, type string, function string, releases array<string>, ownership string, error_prone boolean")


def gate_rows() -> list[tuple[str, str, str, str, int]]:
    """(issue kind, semantic kind, probe, verdict, priority)."""
    out = []
    for i, line in enumerate(x for x in GATE_RULES.split("\n") if x):
        kinds, semantic, probe, verdict = line.split("; ")
        out += [(k, s, p, verdict, i) for k in kinds.split(",") for s in semantic.split(", ") for p in probe.split(" or ")]
    return out


def gate_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(gate_rows(), "issue_kind string, semantic_kind string, probe string, verdict string, priority int")


def candidate_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATE_KINDS, "candidate_kind string, base_mult double, base_add double, issue_kind string, cwe int, fault_class string")


def verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERDICTS, "verdict string, weight_mult double, weight_add double, severity string, verdict_rank int")


def subsumes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSUMES, "cause string, effect string")


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """The rows as a common table expression, for oracles."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"
