"""What a symbol's name says: language, function kind, syscall class, semantic kind, family by naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.rules import any_of, any_sql, classify, classify_sql

# Symbol patterns and name lists that the analysis is defined by, in rule order.
RUST_MARKS = ["$LT$", "$GT$", "$u20$", "$RF$", "$BP$", "$u5b$", "$u5d$"]
LANGUAGE = [
    *[("Rust", "prefix", "_ZN", "contains", m) for m in RUST_MARKS],
    ("Rust", "regex", "^_ZN.*17h[0-9a-fA-F]{16,}E"),
    ("Rust", "prefix", "_R"),
    ("Rust", "prefix", "__rust_"),
    ("Rust", "prefix", "_ZN4core"),
    ("Rust", "prefix", "_ZN5alloc"),
    ("Rust", "prefix", "_ZN3std"),
    ("Rust", "prefix", "_ZN7cstring"),
    ("Rust", "prefix", "_ZN12alloc"),
    ("Cpp", "prefix", "_Z"),
    ("Cpp", "contains", "::"),
    ("Go", "prefix", "_Cfunc_"),
    ("Go", "prefix", "_cgo_"),
    ("Go", "prefix", "runtime."),
    ("Python", "prefix", "Py"),
    ("Python", "contains", "PyObject"),
    ("Java", "prefix", "Java_"),
    ("Java", "contains", "JNI"),
    ("CSharp", "contains", "System.Runtime.InteropServices"),
    ("CSharp", "contains", "DllImport"),
    ("CSharp", "contains", "P/Invoke"),
    ("CSharp", "prefix", "Marshal_"),
    ("CSharp", "prefix", "Marshal."),
    ("Rust", "contains", "rust_box_new"),
    ("Cpp", "contains", "cpp_new_object"),
    ("Cpp", "contains", "cpp_delete_object"),
    ("Go", "contains", "go_alloc"),
    ("Go", "contains", "go_free"),
    ("Java", "contains", "jni_alloc"),
]
MODULE_LANGUAGE = [
    ("Rust", "suffix", ".rs"), ("Rust", "contains", "rust"), ("Go", "suffix", ".go"), ("Go", "contains", "go"), ("Python", "suffix", ".py"), ("Python", "contains", "python"),
    ("Java", "suffix", ".java"), ("Java", "contains", "java"), ("CSharp", "suffix", ".cs"), ("CSharp", "contains", "csharp"), ("Cpp", "suffix", ".cpp"), ("Cpp", "suffix", ".cc"), ("C", "suffix", ".c"),
]
BOUNDARY_LANGUAGE = [
    ("Go", "prefix", "_Cfunc_"), ("Go", "prefix", "_cgo_"), ("Go", "prefix", "runtime."), ("Rust", "prefix", "__rust_"), ("Rust", "contains", "rust_"), ("Python", "prefix", "Py"),
    ("Python", "contains", "PyObject"), ("Java", "prefix", "JNI_"), ("Java", "prefix", "Java_"), ("CSharp", "contains", "Marshal."), ("CSharp", "contains", "IntPtr"),
]
LIBC = ["malloc", "free", "calloc", "realloc", "read", "write", "open", "close", "strlen", "strncpy", "snprintf", "fgets", "getline", "memcpy", "memmove", "memset", "memcmp", "printf", "fprintf", "puts", "fopen", "fclose", "fread", "fwrite"]
DANGEROUS = ["system", "exec", "execve", "execvp", "execv", "execl", "execlp", "execle", "fexecve", "posix_spawn", "posix_spawnp", "popen", "gets", "strcpy", "strcat", "sprintf", "scanf", "getenv"]
SOURCES = ["read", "recv", "gets", "fgets", "fread", "getenv", "getchar", "scanf", "fscanf", "sscanf", "PyArg_ParseTuple", "PyArg_ParseTupleAndKeywords", "PyObject_GetAttr", "PyList_GetItem", "PyTuple_GetItem", "Py_BuildValue"]
SINKS = ["system", "exec", "popen", "strcpy", "strcat", "sprintf", "memcpy", "write", "printf", "Py_DECREF", "PyObject_Del", "PyObject_GC_Del"]
RUNTIME_CALLERS = ["bun_alloc", "9bun_alloc", "MimallocArena", "ZAllocator", "NullableAllocator", "CAllocator", "heap_breakdown", "bss_arena_bump", "c_thunks", "Zone::", "RawVec", "raw_vec", "SliceCursor"]
SEMANTIC_KIND = [
    *[("PythonRefcountInc", "contains", t) for t in ("Py_INCREF", "Py_XINCREF")],
    *[("PythonRefcountDec", "contains", t) for t in ("Py_DECREF", "Py_XDECREF")],
    *[("PythonBorrowedRef", "contains", t) for t in ("PyList_GetItem", "PyTuple_GetItem", "PyDict_GetItem", "PyList_GET_ITEM", "PyTuple_GET_ITEM")],
    *[("PythonOwnedRef", "contains", t) for t in ("PyBytes_FromString", "PyLong_FromLong", "PyFloat_FromDouble", "PyObject_Call", "PyUnicode_FromString", "PyBool_FromLong")],
    *[("PythonGilProtected", "contains", t) for t in ("PyGILState_Ensure", "PyGILState_Release")],
    ("GoDeferCleanup", "contains", "defer", "contains", "free"),
    ("GoFinalizer", "contains", "SetFinalizer"),
    *[("GoRuntimeAlloc", "contains", t) for t in ("runtime.mallocgc", "runtime.newobject", "runtime.newarray")],
    *[("CppUniquePtr", "contains", t) for t in ("unique_ptr", "make_unique")],
    *[("CppSharedPtr", "contains", t) for t in ("shared_ptr", "make_shared")],
    ("CppDestructor", "prefix", "~"),
    ("CppDestructor", "contains", "::~"),
    *[("CppExceptionPath", "contains", t) for t in ("__cxa_throw", "__cxa_begin_catch", "__cxa_end_catch", "__cxa_allocate_exception")],
    ("GoCgoWrapper", "prefix", "_Cgo_"),
    ("GoCgoWrapper", "contains", "_cgo_"),
    *[("CsharpSafeHandle", "contains", t) for t in ("SafeHandle", "ReleaseHandle", "CriticalHandle")],
    *[("CsharpFinalizer", "contains", t) for t in ("Finalize", "~Destructor")],
    *[("CsharpPinvokeMarshal", "contains", t) for t in ("DllImport", "Marshal.AllocHGlobal", "Marshal_AllocHGlobal", "Marshal.FreeHGlobal", "Marshal_FreeHGlobal", "P/Invoke")],
    *[("JavaLocalRef", "contains", t) for t in ("NewLocalRef", "DeleteLocalRef")],
    *[("JavaGlobalRef", "contains", t) for t in ("NewGlobalRef", "DeleteGlobalRef")],
    *[("JavaWeakRef", "contains", t) for t in ("NewWeakGlobalRef", "DeleteWeakGlobalRef")],
    *[("RefcountTransfer", "contains", t) for t in ("Arc::into_raw", "Arc::from_raw")],
    ("WasmMemoryAlloc", "contains", "malloc", "contains", "wasm"),
    ("WasmMemoryFree", "contains", "free", "contains", "wasm"),
    ("EmvalHandle", "prefix", "emscripten_val_"),
    ("EmScriptenRuntimeOp", "prefix", "emscripten_"),
    ("JsImportWrapper", "prefix", "__import_"),
    ("JsExportWrapper", "prefix", "__export_"),
]
_SYSCALL_NAMES = {
    "MemoryManagement": "malloc calloc realloc valloc posix_memalign pvalloc aligned_alloc free reallocarray __rust_alloc __rust_dealloc __rust_realloc __rust_alloc_zeroed mmap munmap mprotect",
    "DataQuery": "strlen strnlen wcslen strcmp strncmp strcasecmp strncasecmp memcmp memmem strstr strchr strrchr index rindex",
    "EnvironmentConfig": "getenv secure_getenv setenv unsetenv putenv sysconf getentropy",
    "StringManipulation": "memcpy memset memmove strcpy strncpy strcat strncat",
    "FileOperation": "open openat close read write pread pwrite lseek stat fstat lstat fstatat unlink rename symlink readlink link chmod fchmod chown fchown mkdir rmdir opendir readdir closedir access faccessat truncate ftruncate sync fsync fdatasync getcwd",
    "IOOperation": "poll select pselect ppoll epoll_create epoll_wait epoll_ctl pipe pipe2 dup dup2 fcntl ioctl msync",
    "NetworkOperation": "socket bind connect listen accept accept4 recv send recvfrom sendto recvmsg sendmsg shutdown getsockname getpeername getsockopt setsockopt ares_inet_pton",
    "ProcessOperation": "fork vfork execve execvp execl execlp exit _exit abort kill raise waitpid wait4 posix_spawn posix_spawnp pthread_exit pthread_setname_np pthread_threadid_np sigaction sigemptyset sigprocmask signal",
}
SYSCALL = [
    ("ComputeAccelerated", "prefix", "highway_"), ("ComputeAccelerated", "prefix", "simdutf__"),
    *[("InternalDispatch", "prefix", t) for t in ("__bun_dispatch__", "Bun__", "BunString__", "WTF__", "WTFStringImpl__")],
    *[("MemoryManagement", "prefix", t) for t in ("_Zdl", "_Zda", "_Znw", "_Zna")],
    ("Unknown", "prefix", "_Z"),
    ("MemoryManagement", "prefix", "_R", "contains", "13drop_in_place"), ("MemoryManagement", "prefix", "_R", "contains", "7dealloc"),
    ("MemoryManagement", "prefix", "_R", "contains", "7raw_vec", "contains", "4grow"), ("MemoryManagement", "prefix", "_R", "contains", "7raw_vec", "contains", "8reserve"),
    *[("ThreadSync", "prefix", "_R", "contains", t) for t in ("5mutex", "6rwlock", "8once_box", "4once", "7condvar")],
    ("ProcessOperation", "prefix", "_R", "contains", "9panicking"), ("ThreadSync", "prefix", "_R", "contains", "4cell"),
    ("Unknown", "prefix", "_R", "contains", "7raw_vec"), ("MemoryManagement", "prefix", "_R", "contains", "5alloc"), ("Unknown", "prefix", "_R"),
    *[("MemoryManagement", "exact", t) for t in ("operator delete", "operator delete[]", "operator new", "operator new[]")],
    *[(kind, "exact", n) for kind, names in _SYSCALL_NAMES.items() for n in names.split()],
]
NORETURN = ["abort", "_exit", "_Exit", "exit", "quick_exit", "__cxa_throw", "__cxa_rethrow", "core::panicking::panic", "core::panicking::panic_fmt", "std::rt::begin_panic", "std::panicking::begin_panic", "__rust_start_panic", "out_of_memory", "raise", "__assert_fail", "__assert_rtn", "_assert"]


def bare(name: Column) -> Column:
    """A symbol without its sigil and quotes."""
    return F.regexp_replace(F.regexp_replace(name, "^@", ""), '^"+|"+$', "")


def language(name: Column) -> Column:
    return classify(bare(name), LANGUAGE)


def module_language(name: Column) -> Column:
    return classify(name, MODULE_LANGUAGE)


def boundary_language(name: Column) -> Column:
    return classify(name, BOUNDARY_LANGUAGE)


def semantic_kind(name: Column) -> Column:
    return classify(name, SEMANTIC_KIND)


def syscall(name: Column) -> Column:
    return classify(name, SYSCALL)


def is_mangled(name: Column) -> Column:
    return F.startswith(name, F.lit("_Z")) | F.startswith(name, F.lit("_R"))


def is_libc(name: Column) -> Column:
    return any_of(name, "exact", LIBC)


def is_dangerous(name: Column) -> Column:
    return any_of(name, "contains", DANGEROUS)


def is_source(name: Column) -> Column:
    return any_of(name, "exact", SOURCES)


def is_sink(name: Column) -> Column:
    return any_of(name, "contains", SINKS)


def is_noreturn(name: Column) -> Column:
    return any_of(name, "exact", NORETURN) | any_of(name, "prefix", ["core::panicking", "alloc::raw_vec"])


def is_intrinsic(name: Column) -> Column:
    return F.startswith(name, F.lit("llvm."))


def is_runtime_caller(name: Column) -> Column:
    return any_of(name, "contains", RUNTIME_CALLERS)


def function_kind(name: Column, is_declaration: Column) -> Column:
    """LibC, ExternalUnknown (dangerous, runtime, undeclared body) or Internal, in that order."""
    runtime = F.startswith(name, F.lit("__rust_")) | F.startswith(name, F.lit("_Unwind_"))
    return F.when(is_libc(name), "LibC").when(is_dangerous(name) | runtime, "ExternalUnknown").when(~is_declaration, "Internal").otherwise("ExternalUnknown")


#: Family effect by the end of a name: (effect, confidence, endings).
NAMED_EFFECTS = [("Reclaim", 0.85, ["from_raw"]), ("Escape", 0.85, ["into_raw"]), ("Acquire", 0.4, ["_alloc", "_create", "_new"]), ("Release", 0.4, ["_free", "_destroy", "_delete", "_deinit", "_close", "_release"])]


def inferred_effect(name: Column) -> Column:
    return classify(name, [(effect, "suffix", e) for effect, _, ends in NAMED_EFFECTS for e in ends], None)


def inferred_confidence(effect: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, confidence, _ in NAMED_EFFECTS:
        out = F.when(effect == name, confidence).otherwise(out)
    return out


def glob_match(name: Column, pattern: Column) -> Column:
    """``*``, ``p*``, ``*s``, ``*m*`` or an exact name."""
    n = F.length(pattern)
    first, last = F.startswith(pattern, F.lit("*")), F.endswith(pattern, F.lit("*"))
    return (
        F.when(pattern == "*", True)
        .when(first & last & (n > 1), F.contains(name, F.substring(pattern, F.lit(2), n - 2)))
        .when(last, F.startswith(name, F.substring(pattern, F.lit(1), n - 1)))
        .when(first, F.endswith(name, F.substring(pattern, F.lit(2), n - 1)))
        .otherwise(name == pattern)
    )


SQL = {
    "language": lambda n: classify_sql(n, LANGUAGE),
    "module_language": lambda n: classify_sql(n, MODULE_LANGUAGE),
    "boundary_language": lambda n: classify_sql(n, BOUNDARY_LANGUAGE),
    "semantic_kind": lambda n: classify_sql(n, SEMANTIC_KIND),
    "syscall": lambda n: classify_sql(n, SYSCALL),
    "is_libc": lambda n: any_sql(n, "exact", LIBC),
    "is_dangerous": lambda n: any_sql(n, "contains", DANGEROUS),
    "is_source": lambda n: any_sql(n, "exact", SOURCES),
    "is_sink": lambda n: any_sql(n, "contains", SINKS),
    "is_runtime_caller": lambda n: any_sql(n, "contains", RUNTIME_CALLERS),
    "inferred_effect": lambda n: classify_sql(n, [(effect, "suffix", e) for effect, _, ends in NAMED_EFFECTS for e in ends], None),
}
